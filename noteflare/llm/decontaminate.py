"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

A document is contaminated by a benchmark item when it holds at least ``threshold`` of
the item's distinct five-word shingles.  Items are partitioned by their number of
shingles into powers of two.  An item's MinHash sketch is the smallest shingle hashes, as many
as the containment allows to be missing from the largest item of its
partition, plus one: a document that holds ``threshold`` of the item holds one of
them at least, however long the document is, so the search loses
nothing.  Candidates are verified on the shingles themselves.  An item of fewer than five
words is one shingle, its whole word sequence.

The documents are read twice; only candidate pairs are ever grouped.  The sketches, and
the rows found with their candidates, are written and broadcast after a check of their number (see ``dimension``), joined by
shuffle beyond it: as long as few documents are hit, no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflare.llm.common import scratch_table, two_hashes, unused
from noteflare.operators.joins import dimension

SHINGLE_WORDS = 5
THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text) -> F.Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _places(tokens, k: int) -> F.Column:
    """0-based starts of the k-word shingles; empty when there are fewer words."""
    return F.when(F.size(tokens) >= k, F.sequence(F.lit(0), F.size(tokens) - k)).otherwise(F.array().cast("array<int>"))


def _shingles(tokens, k: int) -> F.Column:
    """Distinct shingles as text; the outer lambda has the tokens made once, not once a shingle."""
    return F.transform(F.array(tokens), lambda t: F.array_distinct(
        F.transform(_places(t, k), lambda i: F.array_join(F.slice(t, i + 1, k), " "))))[0]


def _item_shingles(tokens, k: int) -> F.Column:
    """Those of an item: its whole sequence if that is shorter; none without words."""
    short = (F.size(tokens) < k) & (F.size(tokens) > 0)
    return F.when(short, F.array(F.array_join(tokens, " "))).otherwise(_shingles(tokens, k))


def _hash_at(tokens, i, k: int) -> F.Column:
    return F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])


def sketches(items: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item, key) MinHash sketches of (item, tokens)."""
    hashed = (items.select("item", "tokens", F.explode(_places(F.col("tokens"), k)).alias("i"))
              .select("item", _hash_at(F.col("tokens"), F.col("i"), k).alias("key")).distinct())
    for n in range(1, k):
        whole = items.where(F.size("tokens") == n).select("item", _hash_at(F.col("tokens"), F.lit(0), n).alias("key"))
        hashed = hashed.unionByName(whole)
    sizes = hashed.groupBy("item").agg(F.count("*").alias("m"))
    partition = F.ceil(F.log2("m"))  # largest size 2**partition
    need = F.floor((F.lit(1.0) - threshold) * F.pow(F.lit(2.0), partition) + F.lit(1e-9)) + 1
    ranked = hashed.join(sizes.select("item", need.alias("need")), "item").withColumn(
        "nth", F.row_number().over(Window.partitionBy("item").orderBy("key")))
    return ranked.where("nth <= need").select("item", "key")


def _row(id_col: str, text_col: str) -> F.Column:
    """What tells documents apart: id and text together, so repeated and null ids never mix."""
    return two_hashes(F.col(id_col), F.col(id_col).isNull(), F.col(text_col))


def containment(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE_WORDS,
                threshold: float = THRESHOLD) -> DataFrame:
    """(id, item, n_shared, n_item, containment) of every pair at or over the threshold.

    Null texts and texts without words have no shingles and match nothing.  An item of fewer
    than ``k`` words is found where its words stand consecutively (n_item 1).  Rows repeating an id with different texts are
    judged apart and may give one result row each; equal rows give one.
    Items repeating an id are likewise told apart by text.  Other columns
    are ignored; an empty table on either side gives an empty result.
    """
    return _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, k, threshold).drop("row")


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id",
          item_text_col: str = "text", k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``containment`` with the documents' ``row`` keys."""
    # Items and documents are known by id and text together, so repeated ids never mix.
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("tokens"),
                             F.xxhash64(F.col(item_col), F.col(item_text_col)).alias("item")).dropDuplicates(["item"])
    known = dimension(items.select("item", "item_id", (F.size("tokens") < k).alias("short"),
                                   _item_shingles(F.col("tokens"), k).alias("parts")))
    # Lengths of items under k words: k - 1 values at most, none in most benchmarks.
    lengths = [r[0] for r in items.select(F.size("tokens").alias("n")).where(F.col("n").between(1, k - 1)).distinct().collect()]
    sketch = dimension(scratch_table(sketches(items, k, threshold), "sketches"))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        _row(id_col, text_col).alias("row"))
    tokens = texts.select("row", words(F.col("text")).alias("tokens"))
    probe = lambda n: tokens.select("row", "tokens", F.explode(_places(F.col("tokens"), n)).alias("i")).select(
        "row", _hash_at(F.col("tokens"), F.col("i"), n).alias("key"))
    probes = probe(k)
    for n in lengths:
        probes = probes.unionByName(probe(n))
    # Rows of fixed width, so that their number proves their size.
    found = scratch_table(probes.join(sketch, "key").select("row", "item").distinct(), "leak-candidates")
    hit = dimension(found.select("row").distinct())
    pairs = (texts.join(hit, "row").select("row", "id", words(F.col("text")).alias("tokens"))
             .select("row", "id", _shingles(F.col("tokens"), k).alias("shingles"),
                     F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("line"))
             .join(dimension(found), "row").join(known, "item"))
    phrase = F.col("line").contains(F.concat(F.lit(" "), F.col("parts")[0], F.lit(" "))).cast("int")
    n_shared = F.when(F.col("short"), phrase).otherwise(F.size(F.array_intersect("parts", "shingles")))
    shared = pairs.select("row", "item", F.col("id").alias(id_col), F.col("item_id").alias(item_col),
                          n_shared.cast("long").alias("n_shared"), F.size("parts").cast("long").alias("n_item"))
    return (shared.withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("containment") >= threshold).dropDuplicates(["row", "item"]).drop("item"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns unchanged."""
    name = unused(docs, "_hit")
    hit = _hits(docs, benchmark, id_col, text_col).select(F.col("row").alias(name)).distinct()
    hit = dimension(scratch_table(hit, "leaked-rows"))
    return docs.join(hit, _row(id_col, text_col) == F.col(name), "left_anti")


ORACLE_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
b as (
  select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark),
n as (select distinct least(len(w), 5) as n from b where len(w) > 0),
ds as (
  select distinct doc_id, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n)),
bs as (
  select distinct item_id, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, least(len(w), 5) as n, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from b where len(w) > 0)),
m as (select item_id, count(*) as n_item from bs group by 1)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*)::double / any_value(n_item) as containment
from bs join ds using (s) join m using (item_id) group by doc_id, item_id having count(*)::double / any_value(n_item) >= 0.8
"""
