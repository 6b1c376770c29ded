"""op9_mixing and the pipeline's last stage return rows in training order."""

import __spark_entry__ as E
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def _key(r):
    return (r["position"] is None, r["position"] or 0.0, r["doc_id"])


def test_op9_in_order(spark):
    rows = E.queries()["op9_mixing"](spark, SF).collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in sorted(rows, key=_key)]


def test_last_stage_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert rows and [r["doc_id"] for r in rows] == [r["doc_id"] for r in sorted(rows, key=_key)]
