"""Contaminated and clean texts under one id, or under none."""

from collections import Counter

from noteflare.llm import decontaminate

ITEM = "seven quiet birds sat on the long grey wall by the old mill"
CLEAN = ["nothing of the kind is said in this text at all", "a second clean text that says other things entirely", None, ""]


def test_clean_by_row(spark):
    rows = [(i, t, "x") for i in (None, 7) for t in [f"so {ITEM} then", *CLEAN, CLEAN[0]]] + [(8, ITEM, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if ITEM not in (r[1] or ""))
    assert decontaminate.containment(docs, bench).count() == 3


def test_text_as_id(spark):
    """A row without id isn't taken for one whose id is that text."""
    docs = spark.createDataFrame([(None, ITEM), (ITEM, None)], "doc_id string, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [(ITEM, None)]
