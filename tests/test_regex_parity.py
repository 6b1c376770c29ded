"""Java-regex columns vs Python ``re`` (the reference's engine) on real multilingual text.

Whole documents of the smallest scale factor: tokens (word pattern of the
vectoriser), leak masking and the case-insensitive flag matcher.
"""

import re

import pytest
from pyspark.sql import functions as F

from noteflare.constants import MASK_PATTERNS
from noteflare.functions.text import mask_terms, matches
from noteflare.operators.vectors import TOKEN_PATTERN
from noteflare.sources.fixtures import base_table

SF = __import__("os").environ.get("PARITY_SF", "/root/testdata/sf0.001")


def py_mask(text):
    if not isinstance(text, str):
        return ""
    for p in MASK_PATTERNS:
        text = re.sub(p, " ", text, flags=re.I)
    return re.sub(r"\s+", " ", text).strip()


@pytest.fixture(scope="module")
def docs(spark):
    d = base_table(spark, SF, "documents")
    return d.select(
        "doc_id", "text",
        F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0).alias("tokens"),
        mask_terms("text").alias("masked"),
        matches("text", "flare|itch|red").alias("hit"),
    ).collect()


def test_tokens_match_python_word_pattern(docs):
    bad = [r["doc_id"] for r in docs if r["tokens"] != re.findall(r"(?u)\b\w\w+\b", r["text"].lower())]
    assert not bad, f"{len(bad)} documents differ: {bad[:5]}"


def test_mask_matches_python(docs):
    bad = [r["doc_id"] for r in docs if r["masked"] != py_mask(r["text"])]
    assert not bad, f"{len(bad)} documents differ: {bad[:5]}"


def test_flag_matches_python(docs):
    bad = [r["doc_id"] for r in docs
           if r["hit"] != bool(re.search("flare|itch|red", r["text"] or "", flags=re.I))]
    assert not bad


WORDS = ["flare", "flares", "flaring", "flare-up", "flare up", "psoriasis flare", "Psoriasis", "FLARE",
         "apply", "Apply", "use", "start", "started", "start ", "triamcinolone", "clobetasol", "ointment",
         "cream", "gel", "bigel", "prescribed", "prescription", "hydrocortisone", "skin", "daily", "used"]
SEPS = [" ", "  ", ", ", ". ", "-", "\t", "\n", "", "; "]


def test_mask_random_sentences_match_python(spark):
    import random

    rnd = random.Random(11)
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(SEPS) for _ in range(rnd.randint(0, 12)))
             for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", mask_terms("t").alias("m")).collect()}
    bad = [i for i, t in enumerate(texts) if got[i] != py_mask(t)]
    assert not bad, [(texts[i], got[i], py_mask(texts[i])) for i in bad[:3]]


def test_feature_flags_random_sentences_match_python(spark):
    """X3 (lower-cased substring) and X4 (case-insensitive regex) on random text."""
    import random

    from noteflare.constants import LEXICON_EXTENDED
    from noteflare.functions.text import flag_any

    vocab = ["Itching", "red", "bothered", "Non-smoker", "smoker", "no known", "No Known", "alcohol: yes",
             "melanoma", "yes", "no active", "Adalimumab", "HUMIRA", "clobetasol", "worse", "flare-up",
             "without relief", "no improvement", "dry skin", "elbow", "silvery", "scale", "plaque", "ÉRYTHÈME"]
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    texts.append(None)
    terms = LEXICON_EXTENDED["complaint_flare_terms"]
    patterns = [LEXICON_EXTENDED["biologic_pattern"], "alcohol.*yes", "melanoma.*yes", "no known",
                LEXICON_EXTENDED["no_medication_pattern"], "silvery|scale", "without relief|no improvement"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", flag_any("t", terms).alias("f"),
                    *[matches("t", p).alias(f"m{k}") for k, p in enumerate(patterns)]).collect()
    for r in out:
        t = texts[r["i"]] or ""
        assert r["f"] == int(any(x in t.lower() for x in terms)), t
        for k, p in enumerate(patterns):
            assert r[f"m{k}"] == bool(re.search(p, t, flags=re.I)), (t, p)
