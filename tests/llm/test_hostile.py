"""Broken pages and thousands of equal rows cost their size, not its square."""

import hashlib
import random
import time

from noteflare.llm import html_extract, suffix_dedup


def test_stray_end_tags_in_linear_time():
    def seconds(n):
        page = "<div>" * n + "</section>" * n + "</b>" * n + "<p>" + "Words of the page. " * 30 + "</p>" + "<span>x" * n + "</div>" * n
        t = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - t

    seconds(500)
    small, large = seconds(4000), seconds(16_000)
    assert large < 4 and large < 10 * max(small, 0.05)


def test_unclosed_and_misnested_tags_keep_their_meaning():
    article = "This is a long enough paragraph of the article, with plain words and no tags. " * 4
    page = f"<nav><a>Menu</nav><article><p>{article}<b>bold<p>{article}</b></article></section></i><footer>Foot<p>er</footer>"
    text = html_extract.main_text(page)
    assert text.count("long enough paragraph") == 8 and "bold" in text and "Menu" not in text and "Foot" not in text


def _rows(n):
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    text = " ".join(word() for _ in range(200))
    other = " ".join(word() for _ in range(100))
    rows = [(7, text)] * n + [(8, other + text[100:400] + other[:50]), (9, other[:150]), (None, "short"), (None, "short")]
    return text, other, rows


def test_thousands_of_equal_rows(spark):
    text, other, rows = _rows(5000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffix_dedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(out) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    twins = {tuple(r)[1:] for r in out if r.doc_id == 7}
    assert twins == {(len(text), len(text), 1, empty)}
    eight = next(r for r in out if r.doc_id == 8)
    kept = other + other[:50]
    assert (eight.n_removed, eight.n_spans) == (300, 1) and eight.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert all(r.n_removed == 0 for r in out if r.doc_id in (9, None))
