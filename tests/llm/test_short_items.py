"""Short benchmark items are found; clean() and keep_one() keep columns of any name."""

from pyspark.sql import functions as F

from noteflare.llm import decontaminate, simhash


def test_items_under_five_words(spark):
    docs = [(1, "He says: two plus two is four."), (2, "two plus three"), (3, "Plus two two plus"), (4, None), (5, "yes"),
            (6, "The eyes have it, yesterday"), (7, "so YES!"), (None, "two, plus; two"), (8, "one long item of six whole words stands here")]
    items = [(10, "two plus two"), (11, "Yes"), (12, "one long item of six whole"), (13, ""), (14, None), (15, "not found anywhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_hit", F.lit(1)).withColumn("_HIT_", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.containment(d, b).collect()}
    assert got == {(1, 10, 1, 1), (None, 10, 1, 1), (5, 11, 1, 1), (7, 11, 1, 1), (8, 12, 2, 2)}
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and {r[0] for r in clean.collect()} == {2, 3, 4, 6}


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "quite another text of words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").withColumn("_kept_row", F.lit(1))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
