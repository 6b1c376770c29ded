"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches of descending id.  A batch's lines become one sorted run of
(line hash, documents, keeper): bucketed and sorted by hash, so that it merges with other
runs without a shuffle.  Each new batch is merge-anti-joined with the runs there are: a line
no run holds is new, and its largest document id in the batch is its keeper; a line that a run
holds only adds its documents to the count.  Then the batch's own run is added.
Whenever a level has ``FANOUT`` runs, they are merged into one run of the next level.

A line's hash is two 64-bit hashes of its key with different seeds.  One document counts once
for a line, and partial counts are combined before anything is shuffled, so a line
that every document holds costs one row a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflare.llm.common import SPACE, scratch_table
from noteflare.operators.joins import dimension
from noteflare.session import ensure_checkpoint_dir

MIN_LENGTH = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text) -> F.Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line) -> F.Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def _hashes(key) -> list[F.Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def long_lines(text, min_length: int = MIN_LENGTH) -> F.Column:
    """array<struct<pos, h1, h2>> of the lines whose key has ``min_length`` code points or more."""
    keyed = F.transform(text_lines(text), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    return F.transform(F.filter(keyed, lambda e: F.length(e["key"]) >= min_length),
                       lambda e: F.struct(e["pos"].alias("pos"), *_hashes(e["key"])))


def distinct_lines(text, min_length: int = MIN_LENGTH) -> F.Column:
    """array<struct<h1, h2>> of a text's different long lines.

    Distinct by the keys, as strings: ``array_distinct`` has a hash set for those, but compares structs pairwise.
    """
    keys = F.array_distinct(F.transform(text_lines(text), line_key))
    return F.transform(F.filter(keys, lambda k: F.length(k) >= min_length), lambda k: F.struct(*_hashes(k)))


def _row_key(id_col, text) -> list[F.Column]:
    """Equal rows share a result, so a row is known by its id and text: two hashes with different seeds."""
    parts = (id_col, id_col.isNull(), F.coalesce(text, F.lit("")))
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(1), *parts).alias("r2")]


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper) by level, kept in the shared checkpoint folder.

    Every run has its keys once, in the same buckets, so runs meet in merge joins without an exchange.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._folders: dict[str, str] = {}

    def write(self, df: DataFrame, *partitions: str) -> str:
        """Save ``df`` as a table bucketed and sorted by hash; returns the table's name."""
        name = "line_run_" + uuid.uuid4().hex
        self._folders[name] = f"{ensure_checkpoint_dir(self.spark)}/{name}"
        out = df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self._folders[name])
        (out.partitionBy(*partitions) if partitions else out).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        """Forget a table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folders.pop(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for name in list(self._folders):
            self.drop(name)
        self.levels = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n_docs, keeper), each key once, all ids below those of earlier batches."""
        seen = F.lit(False)
        for i, name in enumerate(self.runs()):
            run = self.spark.table(name).select(*HASH, F.lit(True).alias(f"in_{i}")).hint("merge")
            batch = batch.join(run, HASH, "left")  # the anti-join's other side stays, for its counts
            seen = seen | F.col(f"in_{i}").isNotNull()
        fresh = F.when(~seen, F.col("keeper"))
        self._push(0, self.write(batch.select(*HASH, "n_docs", fresh.alias("keeper"))))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self.write(self._merged(self.levels[level]))
            for old in self.levels[level]:
                self.drop(old)
            self.levels[level] = []
            self._push(level + 1, merged)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by hash: documents add up, the keeper is that of the run that saw the line first."""
        out = self.spark.table(names[0]).select(*HASH, "n_docs", "keeper")
        for name in names[1:]:
            more = self.spark.table(name).select(*HASH, F.col("n_docs").alias("n_more"), F.col("keeper").alias("k_more"))
            out = out.join(more.hint("merge"), HASH, "full").select(
                *HASH, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))).alias("n_docs"),
                F.coalesce("keeper", "k_more").alias("keeper"))
        return out

    def index(self) -> DataFrame | None:
        """All runs as one (h1, h2, n_docs, keeper); None before the first batch."""
        names = [name for level in reversed(self.levels) for name in level]  # older runs are on higher levels
        return self._merged(names) if names else None


def batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = BATCHES,
            min_length: int = MIN_LENGTH) -> DataFrame:
    """(batch, h1, h2, n_docs, keeper): the long lines of batch 0 (the largest ids) to n - 1 (ids not known last)."""
    shares = [i / n for i in range(1, n)]
    borders = docs.agg(F.percentile_approx(F.col(id_col), shares).alias("at")).first()["at"] or []
    ids = F.col("id")
    batch = sum((F.when(ids > b, 0).otherwise(1) for b in borders), F.lit(0))
    lines = docs.select(F.col(id_col).alias("id"), F.explode(distinct_lines(F.col(text_col), min_length)).alias("e"))
    held = lines.select("id", "e.*", batch.alias("batch"))
    # One exchange sorts every batch's lines: a line's counts of all batches travel in one row.
    mine = [F.col("batch") == b for b in range(len(borders) + 1)]
    by_line = held.groupBy(*HASH).agg(*[f for b, own in enumerate(mine) for f in (
        F.count(F.when(own, 1)).alias(f"n{b}"), F.max(F.when(own, ids)).alias(f"k{b}"))])
    return by_line.select(*HASH, F.inline(F.array(*[
        F.struct(F.lit(b).alias("batch"), F.col(f"n{b}").alias("n_docs"), F.col(f"k{b}").alias("keeper"))
        for b in range(len(mine))]))).where("n_docs > 0")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                   min_length: int = MIN_LENGTH, n_batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the lines found in ``min_docs`` documents or more, written to the shared folder."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout)
    try:
        own = runs.write(batches(docs, id_col, text_col, n_batches, min_length), "batch")
        for b in range(n_batches):
            runs.add(spark.table(own).where(F.col("batch") == b).drop("batch"))
        return scratch_table(runs.index().where(F.col("n_docs") >= min_docs), "repeated-lines")
    finally:
        runs.close()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
          min_length: int = MIN_LENGTH, n_batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped and kept_text.

    A text is split at line feeds; a null or empty one is one empty line.  A line whose key (ASCII white space
    stripped at both ends, A-Z lower-cased) has ``min_length`` code points or more and is found in ``min_docs``
    documents or more goes, with all its repeats, from every document but those with the largest id that holds it.
    Other lines stay as they are, joined by line feeds.

    Each row is a document, so repeated rows count as often as they come and all get the same result.  Rows with
    the same largest id all keep the line.  An id that is null is smaller than any; if no document that holds the
    line has an id, they all keep it.  Ids are numbers.  Input columns named like a new one (in any case) are replaced; an
    empty table gives an empty result.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    key = _row_key(F.col(id_col), F.col(text_col))
    hot = dimension(repeated_lines(docs, id_col, text_col, min_docs, min_length, n_batches, fanout))
    # The key in a projection of its own, below the explode: a hash of the text a row, not a line.
    keyed = docs.select(F.col(id_col).alias("id"), *key, long_lines(F.col(text_col), min_length).alias("lines"))
    places = keyed.select("id", "r1", "r2", F.inline("lines"))
    dropped = (places.join(hot, HASH).where(~F.col("id").eqNullSafe(F.col("keeper")))
               .groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")))  # places of one text at most
    dropped = scratch_table(dropped, "dropped-lines")

    kept_columns = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"),
                       F.col(text_col).alias("text"), *key)
    lines, gone = text_lines(F.col("text")), F.coalesce("gone", F.array().cast("array<int>"))
    # array_except is a hash set over places, so a text of many lines costs no more a line.
    left = F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(F.array_except(
        F.sequence(F.lit(0), F.size(all_lines) - 1), gone), lambda i: F.get(all_lines, i)), "\n"))[0]
    kept_text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(left)
    return rows.join(dropped, ["r1", "r2"], "left").select(
        "row", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept_text.alias("kept_text")).select("row.*", *new)


# Fixed by the task: 40 code points, 5 documents.
ORACLE_SQL = r"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
l as (select doc_id, rid, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
      from (select doc_id, rid, unnest(str_split(text, chr(10))) as line,
                   generate_subscripts(str_split(text, chr(10)), 1) as pos from d)),
hot as (select k, max(doc_id) as keeper from l where length(k) >= 40 group by k having count(distinct rid) >= 5),
marked as (select l.*, hot.k is not null and doc_id is distinct from keeper as gone from l left join hot using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by rid, doc_id
"""
