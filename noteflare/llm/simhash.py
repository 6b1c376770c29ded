"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64-bit sums of XXH64 shingle hashes.  For every distinct
fingerprint the Hamming distances to ``N_PIVOTS`` reference fingerprints are
computed once.  By the triangle inequality two fingerprints within ``d`` bits
differ by at most ``d`` in each of these coordinates, so a pair whose largest
coordinate difference exceeds ``d`` is discarded without being compared;
survivors are verified bit by bit.

Which pairs meet at all: the 64 bits are cut into ``max_bits + 4`` bands.  Two
fingerprints within ``max_bits`` agree on at least four whole bands, so
every fingerprint is filed under each choice of four bands and only
fingerprints of one file are looked at, in order of the first coordinate.  A
file shares about 42 bits, so even a large family of near copies spreads over
many files, and exact copies are one row before anything is filed.  Inside a
file only a spanning forest of links leaves the task, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.llm.common import arrow_stage, scratch_table, two_hashes, unused, with_fields
from noteflare.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
N_PIVOTS = 16
BIG_FILE = 2048


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned 64-bit number (0 without words)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    h, n = xxhash.xxh64_intdigest, len(words)
    if n <= k:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = np.array(hashes[i:i + 65536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per input row, ``fp`` as a signed long."""
    return _printed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle_words)


def _printed(src: DataFrame, shingle_words: int) -> DataFrame:
    """(id, text, ...) rows with ``fp`` in place of the text."""
    rest = [c for c in src.columns if c != "text"]

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in rest], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[*rest, "fp"])

    return arrow_stage(src, run, with_fields(src.select(*rest).schema, "fp long"))


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: XXH64 of their number, as signed longs."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64).view(np.int64).tolist()


def _bands(max_bits: int) -> list[int]:
    """Bit masks of ``max_bits + 4`` neighbouring bands that cover the 64 bits."""
    edges = np.linspace(0, 64, max_bits + 5).astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _filed(classes: DataFrame, max_bits: int) -> DataFrame:
    """(part, key, fp, t0, t1): each fingerprint under every choice of four bands, with its pivot table.

    The 16 distances (0..64, one byte each) travel packed in two longs.
    """
    packed = []
    for half in (pivots()[:8], pivots()[8:]):
        col = F.lit(0).cast("long")
        for i, p in enumerate(half):
            col = col.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        packed.append(col)
    masks = [_signed(sum(c)) for c in combinations(_bands(max_bits), 4)]
    files = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m).alias("m")) for i, m in enumerate(masks)]))
    tables = classes.select("fp", packed[0].alias("t0"), packed[1].alias("t1"))
    return (tables.select("*", files.alias("f"))
            .select(F.xxhash64(F.col("f.c"), F.col("fp").bitwiseAND(F.col("f.m"))).alias("key"), "fp", "t0", "t1"))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _probe(bits, rows, max_bits):
    """Exact links of rows with too many neighbours in their file: look every near fingerprint up."""
    if not len(rows):
        return
    order = np.argsort(bits, kind="stable")
    known = bits[order]
    for weight in range(1, max_bits + 1):
        for flips in combinations(range(64), weight):
            wanted = bits[rows] ^ np.uint64(sum(1 << f for f in flips))
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[at] == wanted
            if hit.any():
                yield rows[hit], order[at[hit]]


def _links_in_files(key, fp, t0, t1, max_bits):
    """Links (a spanning forest per file) among rows sorted by key and first distance."""
    n = len(fp)
    coords = np.concatenate([t0.view(np.uint8).reshape(n, 8), t1.view(np.uint8).reshape(n, 8)], axis=1).astype(np.int8)
    bits = fp.view(np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))  # end of each row's file
    # Only rows whose first coordinate is at most max_bits above can link: the window's end, by file.
    first = coords[:, 0].astype(np.int64)
    order_key = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) * 256 + first
    stop = np.minimum(np.searchsorted(order_key, order_key + max_bits, side="right"), ends)
    left, right = [], []
    width = stop - np.arange(n)
    live, step = np.flatnonzero((width > 1) & (width <= BIG_FILE)), 1
    root = np.arange(n)
    while len(live):
        i, j = live, live + step
        near = (np.abs(coords[i] - coords[j]).max(axis=1) <= max_bits)  # pivot tables
        i, j = i[near], j[near]
        same = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits  # survivors
        left.append(i[same])
        right.append(j[same])
        if sum(map(len, left)) > 1_000_000:  # keep a forest, not the pairs
            root = _forest(n, np.concatenate([*left, np.arange(n)]), np.concatenate([*right, root]))
            left, right = [], []
        step += 1
        live = live[stop[live] > live + step]
    for i, j in _probe(bits, np.flatnonzero(width > BIG_FILE), max_bits):
        root = _forest(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, root]))
    root = _forest(n, np.concatenate([*left, np.arange(n)]), np.concatenate([*right, root]))
    linked = np.flatnonzero(root != np.arange(n))
    return fp[linked], fp[root[linked]]


def near_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links that connect every two distinct fingerprints within ``max_bits``.

    Links inside a file are given as a spanning forest, so their transitive
    closure (not each pair) is the whole relation.
    """
    first = F.col("t0").bitwiseAND(F.lit(255))
    sorted_files = _filed(classes, max_bits).repartition("key").sortWithinPartitions("key", first)

    def run(batches):
        held = None
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            ready, held = [x[:cut] for x in now], [x[cut:] for x in now]
            if cut:
                yield links(ready)
        if held is not None and len(held[0]):
            yield links(held)

    def links(cols):
        u, v = _links_in_files(*[np.ascontiguousarray(x) for x in cols], max_bits)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return arrow_stage(sorted_files.select("key", "fp", "t0", "t1"), run, "u long, v long")


def _rooted(fps: DataFrame, low: F.Column, max_bits: int) -> DataFrame:
    """(fp, low, root): every distinct fingerprint with an aggregate of its rows and its component."""
    classes = scratch_table(fps.groupBy("fp").agg(low.alias("low")), "simhash-classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id): one row per input row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits.  Null and empty texts have fingerprint zero and
    link like any other.  Rows without an id take part; a component whose
    rows have no id at all has a null ``component_id``.  Rows repeating an id
    give one result row each.  Other columns are ignored; an empty table
    gives an empty result.
    """
    fps = scratch_table(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    rooted = _rooted(fps, F.min("id"), max_bits)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, all columns unchanged.

    The row with the smallest id, rows without an id last; among rows of one id (or
    none) the one with the smallest hash of all columns (but maps).  Of wholly equal rows one is kept.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keys, kept_keys = [unused(docs, "_row_1"), unused(docs, "_row_2")], [unused(docs, "_kept_1"), unused(docs, "_kept_2")]
    row = two_hashes(*hashed, *[c.isNull() for c in hashed])
    rows = docs.withColumns({keys[0]: row["h1"], keys[1]: row["h2"]})
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*keys).alias("row"))
    fps = scratch_table(_printed(src, SHINGLE_WORDS), "simhash")
    rooted = _rooted(fps, F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "row")), MAX_BITS)
    kept = rooted.groupBy("root").agg(F.min("low").alias("low")).select(
        *[F.col("low.row")[k].alias(name) for k, name in zip(keys, kept_keys)])
    # Equal rows first: they meet before the shuffle that the join uses again.
    same = [F.col(k) == F.col(name) for k, name in zip(keys, kept_keys)]
    return rows.dropDuplicates(keys).join(kept, same, "left_semi").drop(*keys)
