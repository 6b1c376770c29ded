"""Mixing keeps its input columns and spreads rows that share an id or have none."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from noteflare.llm import mixing

SF = "/root/testdata/sf0.001"


def test_all_input_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Taken", F.lit("clash")).withColumn("row", F.lit(1))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "size", "source_size", "target",
                           "taken", "position", "positions"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in out.collect()} == texts
    narrow = {r.doc_id: r.taken for r in mixing.mix(docs, keep=()).collect()}
    assert {r.doc_id: r.taken for r in out.collect()} == narrow


def test_pipeline_mix_has_the_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(docs.columns) < set(out.columns) and out.where("text is null or text = ''").count() == 0


def test_null_and_repeated_ids_spread_over_the_ranges(spark):
    n = 9000
    docs = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
                                 F.concat(F.lit("text number "), "id").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(docs, rows_per_range=100).select("doc_id", "text", "position")
    places = [r.position for r in out.where("doc_id is null").collect() if r.position is not None]
    parts = Counter(int(p * 20) for p in places)
    assert len(places) == n // 3 and max(parts.values()) < 3 * len(places) / 20  # a shared key would put all in one stretch
    assert E.queries()["op9_mixing"](spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken", "position"]
