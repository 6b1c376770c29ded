"""Vector code compression: product codes trained by Lloyd rounds over partition-local cover trees.

A vector becomes integers and is cut into consecutive parts; each part position has a codebook.
Every partition packs its vectors into blocks and builds, once, one cover tree a block and part: the
points in depth-first order, so that a subtree is a range of them, with each node's point and the
largest distance from it to a point below.  A round walks the trees from their roots: a node whose nearest
entry is nearer than every other by more than twice its radius gives its whole subtree to that entry, and the subtree's
sum is a difference of cumulative sums.  Other nodes are ambiguous and descend; points of ambiguous
leaves are compared exactly.  Distances are integers, so results do not depend on how rows are partitioned.

Tasks send one sum an entry, whatever the rows they hold; only codebooks come to the driver.
The trees are written once to the shared folder, and each round reads them where they lie: no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from noteflare.llm.common import arrow_stage, drop_scratch, scratch_table
from noteflare.operators.joins import dimension

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 2 ** 26  # integer components are held to this size, so that squared distances fit 64 bits
BLOCK_CELLS = 2 ** 17  # components a block: half a megabyte of vectors
BLOCK_ROWS = 2048
LEAF = 16
_PIECES = {"points": np.int32, "order": np.int32, "first": np.int32, "last": np.int32, "child": np.int32,
           "child_end": np.int32, "radius": np.float64}


# ---------------------------------------------------------------------------
# cover trees of one block (numpy, inside tasks)
# ---------------------------------------------------------------------------

def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer arrays.

    The float product is exact while every intermediate is under 2**53; else 64-bit integers.
    """
    top = 2 * max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.float64 if top * top * max(a.shape[1], 1) < 2 ** 53 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The cover tree of integer ``points`` as flat arrays (see ``_PIECES``).

    A node stands for the range [first, last) of the ordered points and its own point is the first of them.  Its
    children are a net: each covers what lies within half the node's radius, and no child's point lies within
    that distance of an earlier one's.  Nodes of at most ``LEAF`` points, and of equal points, have no children.
    """
    order = np.arange(len(points))
    first, last, child, child_end, radius = [0], [len(points)], [0], [0], [0.0]
    node = 0
    while node < len(first):  # nodes are listed level by level, children side by side
        lo, hi = first[node], last[node]
        rows = order[lo:hi].copy()
        away = _squared(points[rows], points[rows[:1]])[:, 0]
        reach = float(away.max(initial=0))
        radius[node] = np.sqrt(reach)
        child[node] = child_end[node] = len(first)
        if reach > 0 and hi - lo > LEAF:
            done, rest = lo, rows
            while len(rest):
                near = _squared(points[rest], points[rest[:1]])[:, 0] * 4 <= reach
                group = rest[near]
                order[done:done + len(group)] = group
                first.append(done)
                last.append(done + len(group))
                child.append(0)
                child_end.append(0)
                radius.append(0.0)
                done += len(group)
                rest = rest[~near]
            child_end[node] = len(first)
        node += 1
    made = {"points": points[order], "order": order, "first": first, "last": last, "child": child,
            "child_end": child_end, "radius": radius}
    return {k: np.asarray(v, dtype=_PIECES[k]) for k, v in made.items()}


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def assign(tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry of each ordered point, sums and counts by entry, distances computed).

    Ties go to the lower entry.  Comparisons of square roots leave a margin, so rounding can only make a node descend.
    """
    points, first, last = tree["points"].astype(np.int64), tree["first"], tree["last"]
    cum = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
    np.cumsum(points, axis=0, out=cum[1:])
    nearest = np.zeros(len(points), dtype=np.int32)
    sums, counts = np.zeros((len(book), points.shape[1]), dtype=np.int64), np.zeros(len(book), dtype=np.int64)
    nodes, compared = np.arange(min(1, len(points))), 0
    while len(nodes):
        away = _squared(points[first[nodes]], book)
        compared += away.size
        best = away.argmin(1)
        low = away[np.arange(len(nodes)), best].astype(np.float64)
        away[np.arange(len(nodes)), best] = np.iinfo(np.int64).max if away.dtype == np.int64 else np.inf
        radius = tree["radius"][nodes]
        whole = (radius == 0) | (np.sqrt(away.min(1).astype(np.float64)) > (np.sqrt(low) + 2 * radius) * (1 + 1e-9) + 1e-9)
        if len(book) == 1:
            whole[:] = True
        at, entry = nodes[whole], best[whole]
        nearest[_ranges(first[at], last[at])] = np.repeat(entry, last[at] - first[at])
        np.add.at(sums, entry, cum[last[at]] - cum[first[at]])
        np.add.at(counts, entry, last[at] - first[at])
        open_ = nodes[~whole]
        leaf = tree["child"][open_] == tree["child_end"][open_]
        rows = _ranges(first[open_[leaf]], last[open_[leaf]])
        if len(rows):
            away = _squared(points[rows], book)
            compared += away.size
            nearest[rows] = entry = away.argmin(1)
            np.add.at(sums, entry, points[rows])
            np.add.at(counts, entry, 1)
        nodes = _ranges(tree["child"][open_[~leaf]], tree["child_end"][open_[~leaf]])
    return nearest, sums, counts, compared


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    """Borders of the parts; if the length is no multiple, the first parts are longer by one."""
    return [0, *np.cumsum([dim // parts + (i < dim % parts) for i in range(parts)]).tolist()]


# ---------------------------------------------------------------------------
# Spark stages
# ---------------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, vec): rows whose vector has no null or non-finite component, as integers floor(1024 x)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("x"))
    whole = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return rows.where(F.col("x").isNotNull() & ~F.exists("x", bad)).select(
        "id", "label", F.size("x").alias("dim"), F.transform("x", whole).alias("vec"))


def tree_blocks(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """One row a block of vectors of one length: (dim, ids, labels, trees), built where the vectors lie."""
    piece = T.StructType([T.StructField(k, T.BinaryType()) for k in _PIECES])
    schema = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("trees", T.ArrayType(piece))])
    arrow = to_arrow_schema(schema)

    def block(dim, held):
        ids, labels, vecs = zip(*held, strict=True)
        points = np.array(vecs, dtype=np.int32).reshape(len(vecs), dim)
        at = cuts(dim, parts)
        trees = [{k: v.tobytes() for k, v in cover_tree(points[:, a:b]).items()} for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids, "labels": labels, "trees": trees}], schema=arrow)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", "id", "label", "vec")), strict=True):
                mine = held.setdefault(dim, [])
                mine.append(row)
                if len(mine) >= min(BLOCK_ROWS, max(64, BLOCK_CELLS // max(dim, 1))):
                    yield block(dim, held.pop(dim))
        for dim, mine in held.items():
            yield block(dim, mine)

    return arrow_stage(rows, build, schema)


def _trees(row: dict, parts: int) -> list[dict[str, np.ndarray]]:
    at, n, out = cuts(row["dim"], parts), len(row["ids"]), []
    for tree, a, b in zip(row["trees"], at, at[1:]):
        flat = {k: np.frombuffer(v, dtype=_PIECES[k]) for k, v in tree.items()}
        out.append(flat | {"points": flat["points"].reshape(n, b - a)})
    return out


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> dict[int, list[np.ndarray]]:
    """By vector length, each part's codebook: that part of the vectors with the smallest ids."""
    by_id = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "vec")  # a group limit: few rows a task
    least = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= entries)
    books: dict[int, list[np.ndarray]] = {}
    found: dict[int, list] = {}
    for r in least.select("dim", "nth", "vec").orderBy("dim", "nth").collect():  # ``entries`` vectors of each length
        found.setdefault(r["dim"], []).append(r["vec"])
    for dim, vecs in found.items():
        whole, at = np.array(vecs, dtype=np.int64).reshape(len(vecs), dim), cuts(dim, parts)
        books[dim] = [whole[:, a:b] for a, b in zip(at, at[1:])]
    return books


def lloyd_round(blocks: DataFrame, books: dict[int, list[np.ndarray]], parts: int = PARTS) -> dict[int, list[np.ndarray]]:
    """Codebooks after one round: entries become floored means of their parts, unused ones stay."""
    schema = "dim int, part int, entry int, n long, total array<long>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: [np.zeros(b.shape, dtype=np.int64) for b in book] for d, book in books.items()}
        counts = {d: [np.zeros(len(b), dtype=np.int64) for b in book] for d, book in books.items()}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                for i, tree in enumerate(_trees(row, parts)):
                    _, s, c, _ = assign(tree, books[dim][i])
                    sums[dim][i] += s
                    counts[dim][i] += c
        out = [{"dim": d, "part": i, "entry": int(e), "n": int(n[e]), "total": sums[d][i][e].tolist()}
               for d, per_part in counts.items() for i, n in enumerate(per_part) for e in np.flatnonzero(n)]
        kinds = [("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                 ("total", pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    widest = max((b.shape[1] for book in books.values() for b in book), default=0)
    totals = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(widest)]
    moved = arrow_stage(blocks, partial, schema).groupBy("dim", "part", "entry").agg(F.sum("n").alias("n"), *totals)
    after = {d: [b.copy() for b in book] for d, book in books.items()}
    for r in moved.collect():  # one row an entry
        entry = after[r["dim"]][r["part"]][r["entry"]]
        entry[:] = [r[f"s{i}"] // r["n"] for i in range(len(entry))]
    return after


def encode(blocks: DataFrame, books: dict[int, list[np.ndarray]], parts: int = PARTS) -> DataFrame:
    """(id, label, dim, code, error) of every vector in the blocks."""
    schema = T.StructType([
        T.StructField("id", blocks.schema["ids"].dataType.elementType),
        T.StructField("label", blocks.schema["labels"].dataType.elementType), T.StructField("dim", T.IntegerType()),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, dim = len(row["ids"]), row["dim"]
                codes, errors = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for i, tree in enumerate(_trees(row, parts)):
                    book = books[dim][i]
                    nearest = assign(tree, book)[0]
                    codes[tree["order"], i] = nearest
                    errors[tree["order"]] += ((tree["points"] - book[nearest]) ** 2).sum(1)
                cols = [row["ids"], row["labels"], [dim] * n, [c.tobytes().hex() for c in codes], errors]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return arrow_stage(blocks, run, schema)


def books_sha256(book: list[np.ndarray]) -> str:
    """Hash of all entries' components by part, entry and position, as comma-joined decimals."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every vector whose components are all finite.

    Each component becomes floor(1024 x), held to +-2**26 (x beyond +-65,536 counts as that).  Vectors that are null or
    hold a null or non-finite component are left out.  The first codebooks are the parts of the ``entries`` smallest
    ids (null ids last, ties by vector, fewer rows: as many entries).  Rows that repeat an id are vectors of their
    own.  Vectors of another length have codebooks of their own; a length that is no multiple of ``parts`` gives
    its first parts one component more, and an empty vector has distance 0 to all.  ``label_error`` adds the
    errors of equal labels, nulls together.  Other columns are ignored; an empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("an index is one byte: at most 256 entries")
    rows = scratch_table(integer_vectors(vectors, id_col, vec_col, label_col), "integer-vectors")
    books = first_books(rows, parts, entries)
    blocks = scratch_table(tree_blocks(rows, parts), "cover-trees")
    for _ in range(rounds):
        books = lloyd_round(blocks, books, parts)
    coded = scratch_table(encode(blocks, books, parts), "vector-codes")
    drop_scratch(rows)
    drop_scratch(blocks)
    hashes = F.lit(None).cast("string")
    for dim, book in books.items():
        hashes = F.when(F.col("dim") == dim, books_sha256(book)).otherwise(hashes)
    by_label = dimension(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
        hashes.alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> str:
    """The same codes by plain Lloyd rounds over long rows (vectors of one length, a multiple of ``parts``)."""
    near = """
{a} as (select rid, p, min({{'d': d, 'e': e}}) as best from (
  select x.rid, x.p, b.e, sum((x.x - b.c) * (x.x - b.c))::bigint as d
  from xs x join {b} b on b.p = x.p and b.i = x.i group by x.rid, x.p, b.e) group by rid, p)"""
    sql = f"""
with good as (
  select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label, embedding as v from embeddings
  where embedding is not null and rowid_ok(embedding)),
xs as (select rid, p, i, floor(1024 * v[p * (len(v) // {parts}) + i]::double)::bigint as x
  from good, range({parts}) t(p), range(1, 65537) u(i) where i <= len(v) // {parts}),
b0 as (select p, rid - 1 as e, i, x as c from xs where rid <= {entries}),"""
    sql = sql.replace("rowid_ok(embedding)", "len(embedding) = (select count(*) from (select unnest(embedding) as y) "
                      "where y is not null and not isnan(y) and not isinf(y))")
    for r in range(rounds):
        sql += near.format(a=f"a{r}", b=f"b{r}") + f""",
m{r} as (select x.p, a.best.e as e, x.i, floor(sum(x.x)::double / count(*))::bigint as c
  from xs x join a{r} a on a.rid = x.rid and a.p = x.p group by x.p, a.best.e, x.i),
b{r + 1} as (select b.p, b.e, b.i, coalesce(m.c, b.c) as c from b{r} b left join m{r} m on m.p = b.p and m.e = b.e and m.i = b.i),"""
    return sql + near.format(a="z", b=f"b{rounds}") + f""",
coded as (select g.vec_id, g.label, string_agg(printf('%02x', z.best.e), '' order by z.p) as code, sum(z.best.d)::bigint as error
  from good g join z on z.rid = g.rid group by g.rid, g.vec_id, g.label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(c::varchar, ',' order by p, e, i)) from b{rounds}) as codebooks_sha256
from coded"""
