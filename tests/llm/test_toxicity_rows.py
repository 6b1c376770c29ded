"""op10 learns from every labelled row that is not held out, broadcast or shuffled."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from noteflare.llm import toxicity


def test_every_labelled_row_is_learnt_from(spark):
    n = 60_000
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic").unionByName(
        spark.createDataFrame([(0, 0), (None, 1), (9, None)], "doc_id long, toxic int"))
    rows = toxicity.labelled_rows(labels, "doc_id", "toxic")
    want = {i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2}
    got = {r["id"]: (r["toxic"], r["role"]) for r in rows.collect()}
    assert set(got) == want and all(t == int(i % 3 == 0) for i, (t, _) in got.items())
    assert 0.24 < sum(r == "tune" for _, r in got.values()) / len(got) < 0.26


def test_model_is_the_same_by_shuffle(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id as doc_id", "concat('plain words ', cast(id % 40 as string), if(id % 4 = 0, ' vile', ' mild')) as text")
    labels = spark.range(600).selectExpr("id as doc_id", "cast(id % 4 = 0 or id % 31 = 0 as int) as toxic")
    sent = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_SENT", 10)
    moved = toxicity.fit(docs, labels)
    assert moved.slope == pytest.approx(sent.slope, rel=1e-6) and moved.index == sent.index
    assert (moved.pair_count == sent.pair_count).all()


def test_logistic_fit_minimises_the_penalised_loss(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 2)) * [2.0, 0.5] + [1.0, -3.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, toxic int")
    w, mean, scale = toxicity._logistic(rows)
    z = np.c_[np.ones(400), (x - mean) / scale]
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (y - p) - np.array([1e-6, 1e-2, 1e-2]) * w).max() < 1e-5
    assert toxicity._logistic(rows.where("toxic = 1")) is None


def _corpus(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdéf") for _ in range(rnd.randint(2, 4))) for _ in range(500)]
    rows = []
    for i in range(400):
        words = [vocab[int(500 * rnd.random() ** 3)] for _ in range(rnd.randint(0, 60))]
        if i % 5 == 0:
            words[rnd.randrange(len(words) + 1):0] = ["vile", "thing", f"rare{i % 7}x{i % 3}"]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(
        [(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def _plain_features(rows, learnt, weights):
    """Features of every text by dictionaries of all words and bigrams, with nothing left out."""
    words, pairs, corpus, seen = {}, {}, Counter(), {}
    for i, text, toxic in rows:
        own = text.split()
        corpus.update(own)
        if learnt.get(i) == "count":
            for table, keys in ((words, own), (pairs, list(zip(own, own[1:])))):
                for k in set(keys):
                    table.setdefault(k, [0, 0])[toxic] += 1
    before = Counter(w for _, w in pairs)
    one = lambda f, *x: float(f(*[np.array([float(v)]) for v in x])[0])
    gain = {w: one(weights.word, *n, corpus[w], before[w]) for w, n in words.items()}
    ratio = {k: one(weights.pair, *n, gain[k[1]]) for k, n in pairs.items()}
    assert weights.words == tuple(sum(n[c] for n in words.values()) for c in (0, 1)) and weights.kinds == len(pairs)
    assert weights.pairs == tuple(sum(n[c] for n in pairs.values()) for c in (0, 1)) and weights.corpus[1] == len(corpus)
    for i, text, _ in rows:
        own = text.split()
        each = [ratio.get((h, w), gain.get(w, 0.0)) for h, w in zip([None, *own], own)]
        seen[text] = sum(each) / max(len(own), 1), sum(max(g - toxicity.STRONG, 0) for g in each) / max(len(own), 1)
    return seen


def test_every_word_and_bigram_is_weighed(spark, monkeypatch):
    """Against plain dictionaries; what the head holds, and the sizes of blocks and buckets, change nothing."""
    rows, docs, labels = _corpus(spark)
    learnt = {r["id"]: r["role"] for r in toxicity.labelled_rows(labels, "doc_id", "toxic").collect()}
    found = []
    for limits in ({}, {"MAX_WORDS": 16, "MAX_BIGRAMS": 3, "BLOCK_WORDS": 500, "BUCKET_WORDS": 700}, {"MIN_WORD": 1, "MIN_BIGRAM": 1}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(toxicity, name, value)
            model = toxicity.fit(docs, labels)
            keyed = docs.select(toxicity._text_key("text").alias("key"), "text")
            got = {r["text"]: (r["a"], r["b"]) for r in toxicity._features(keyed, model).join(keyed, "key").collect()}
            found.append({r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()})
        want = _plain_features(rows, learnt, model.weights)
        assert got.keys() == want.keys()
        assert all(got[t] == pytest.approx(want[t], abs=1e-6) for t in want)
    assert len(model.index) > 300 and all(f == pytest.approx(found[0], abs=1e-9) for f in found[1:])


def test_an_expression_of_few_texts_weighs(spark):
    """A word of three toxic texts and a bigram of three, whose words are common, raise their texts' scores."""
    plain = [f"w{i % 37} w{i % 11} w{i % 5} up down" for i in range(800)]
    learnt = {r["id"]: r["role"] for r in toxicity.labelled_rows(
        spark.range(800).selectExpr("id as doc_id", "0 as toxic"), "doc_id", "toxic").collect()}
    counted = [i for i in range(800) if learnt.get(i) == "count"]
    toxic = set(counted[:60])
    text = {i: t for i, t in enumerate(plain)}
    for i in counted[:3]:
        text[i] += " seldom"
    for i in counted[3:6]:
        text[i] = text[i].replace("up down", "down up")
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([("plain", "w1 up down"), ("word", "w1 up seldom"), ("unseen", "w1 up new"),
                                   ("pair", "w1 down up"), ("apart", "w1 down w1 up")], "id string, text string")
    keyed = asked.select(toxicity._text_key("text").alias("key"), "id")
    a = {r["id"]: r["a"] for r in toxicity._features(asked.select(toxicity._text_key("text").alias("key"), "text"), model).join(keyed, "key").collect()}
    assert a["word"] > a["unseen"] and a["pair"] > a["apart"]
