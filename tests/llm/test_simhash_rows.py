"""One row a near-duplicate group, with repeated and null ids."""

from collections import Counter

from noteflare.llm import simhash

A, B, C = ("the first text of a group that tells of a mill", "another text altogether about ships and the sea",
           "a third one, on bread and how it is baked")


def _kept(spark, rows):
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra string"))
    assert out.columns == ["doc_id", "text", "extra"]
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_repeated_ids(spark):
    # Id 1 is smallest for A, twice with other columns and twice wholly equal; it holds a text of B's group too.
    rows = [(1, A, "x"), (1, A, "y"), (1, A, "y"), (2, A, "x"), (1, B, "x"), (0, B, "x"), (1, C, None), (1, C, "z")]
    assert _kept(spark, rows) == Counter([(1, A), (0, B), (1, C)])


def test_null_ids(spark):
    rows = [(None, A, "x"), (3, A, "x"), (None, B, "x"), (None, B, "y"), (None, C, "x"), (None, C, "x"), (4, None, "x"), (None, "", None)]
    assert _kept(spark, rows) == Counter([(3, A), (None, B), (None, C), (4, None)])
