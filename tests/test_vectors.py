"""V3 and V4: the sketch loses no term, the counts are exact, and no text is shuffled."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteflare.operators import vectors as V


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    words = [f"wörd{i}" for i in range(400)]
    rows = [(i, None if i == 3 else "" if i == 4 else " ".join(rnd.choices(words, [1 / (j + 1) for j in range(400)], k=rnd.randint(1, 40))))
            for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()


def _counts(docs):
    df, tf = Counter(), Counter()
    for r in docs.collect():
        w = re.findall(r"\w{2,}", (r.text or "").lower())
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        tf.update(terms)
        df.update(set(terms))
    return df, tf


@pytest.mark.parametrize("width,depth", [(64, 1), (512, 2), (1 << 19, 2), (1, 0)])
def test_vocabulary_is_exact_whatever_the_sketch(docs, width, depth):
    df, tf = _counts(docs)
    want = {t: (df[t], tf[t]) for t in df if df[t] >= 4}
    voc = V.fit_vocabulary(docs, "text", max_features=10_000, min_df=4, width=width, depth=depth)
    assert {r.term: (r.df, r.tf_total) for r in voc.terms.collect()} == want


def test_sketch_keeps_all_frequent_and_rules_out_most_rare_terms(docs):
    df, _ = _counts(docs)
    sketch = V.frequency_sketch(V.tokens(docs, "text"), 4, width=1 << 14)
    terms = docs.sparkSession.createDataFrame([(t, n) for t, n in df.items()], "term string, n long")
    held = terms.withColumn("kept", sketch.may_hold(F.col("term"))).collect()
    assert all(r.kept for r in held if r.n >= 4)
    rare = [r.kept for r in held if r.n < 4]
    assert sum(rare) < 0.2 * len(rare)


def test_text_is_never_shuffled(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    voc = V.fit_vocabulary(read, "text", min_df=4)
    plan = voc.terms._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r" Exchange hashpartitioning\((\w+)#", plan))
    assert "term" in keys and "RoundRobin" not in plan and not {"text", "terms", "doc_id"} & keys
    names = V.Vocabulary(spark.createDataFrame(voc.terms.collect(), voc.terms.schema), voc.n_docs)
    weights = V.tfidf(read, names, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in weights and "Exchange RoundRobin" not in weights and "BroadcastExchange" in weights
