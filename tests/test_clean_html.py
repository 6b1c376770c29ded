"""X1 against a brute-force reference: Python's stdlib HTML parser, page by page.

The DuckDB oracle shares the regex recipe, so this test checks the recipe
itself on the driver's ``pages`` table (whole pages, smallest scale factor).
"""

import re
from html.parser import HTMLParser

import pytest

from noteflare.functions.text import clean_html
from noteflare.sources.fixtures import base_table

SF = "/root/testdata/sf0.001"


class _Text(HTMLParser):
    """Text nodes of a page, skipping script/style/template content."""

    SKIP = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def reference_text(html: str | None) -> str:
    if not isinstance(html, str):
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\s+", " ", " ".join(p.parts)).strip()


@pytest.fixture(scope="module")
def pages(spark):
    df = base_table(spark, SF, "pages")
    return df.select("page_id", "html", clean_html("html").alias("text")).collect()


def test_every_page_matches_the_parser(pages):
    bad = [r["page_id"] for r in pages if r["text"] != reference_text(r["html"])]
    assert not bad, f"{len(bad)} of {len(pages)} pages differ, e.g. {bad[:5]}"


def test_lone_angle_bracket_and_entities(spark):
    rows = [("BSA < 5%, <b>itch</b> &amp; dry&nbsp;skin",), (None,), ("<p>a</p><p>b</p>",)]
    df = spark.createDataFrame(rows, "h string").select(clean_html("h").alias("t"))
    assert [r["t"] for r in df.collect()] == ["BSA < 5%, itch & dry skin", "", "a b"]


def _random_html(rnd):
    words = ["Itch", "BSA < 5%", "a&amp;b", "x &amp y", "&lt;tag&gt;", "&quot;q&quot;", "it&#39;s", "&copy;",
             "&middot;", "&nbsp;", "&unknown;", "plain", "Élan", " ", "\n", "  "]
    parts = []
    for _ in range(rnd.randint(0, 10)):
        k = rnd.random()
        if k < 0.35:
            parts.append(rnd.choice(words))
        elif k < 0.55:
            tag = rnd.choice(["p", "b", "div", "span", "td", "br"])
            attr = rnd.choice(["", ' class="c"', " id=x", ' data-v="1 2"', ' title="a>b"', " t='x > y' z=1", " a=b=c"])
            parts.append(f"<{tag}{attr}>{rnd.choice(words)}</{tag}>")
        elif k < 0.65:
            parts.append(f"<!-- {rnd.choice(words)} -->")
        elif k < 0.75:
            parts.append(f"<script type=\"t\">var a = '{rnd.choice(words)}';</script>")
        elif k < 0.82:
            parts.append(f"<style>.c{{color:red}} {rnd.choice(words)}</style>")
        elif k < 0.9:
            parts.append("<!DOCTYPE html>")
        else:
            parts.append(f"<br/>{rnd.choice(words)}<hr>")
    return "".join(parts)


def test_open_script_and_style_run_to_the_end(spark):
    rows = [("a<script>var x = 1; if (x < 2) y()",), ("<p>b</p><style>.c{}",), ('<a title="a>b">x</a>',),
            ("5 &lt; 6 &ampx &copyright;",), ("&",), ("x" * 100_000 + "<b " + 'c="d>" ' * 2_000 + ">&deg;",)]
    df = spark.createDataFrame(rows, "h string").select(clean_html("h").alias("t"))
    assert [r["t"] for r in df.collect()] == ["a", "b", "x", "5 < 6 &x ©right;", "&", "x" * 100_000 + " °"]


def test_random_fragments_match_the_parser(spark):
    import random

    rnd = random.Random(3)
    docs = [_random_html(rnd) for _ in range(500)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", clean_html("h").alias("t")).collect()}
    bad = [i for i, d in enumerate(docs) if got[i] != reference_text(d)]
    assert not bad, [(docs[i], got[i], reference_text(docs[i])) for i in bad[:3]]


def test_random_references_match_unescape(spark):
    """Names of HTML 5 and legacy names, whole, cut short and running on; numbers of every kind."""
    import html
    import random

    from pyspark.sql import functions as F

    from noteflare.functions.text import decode_references, entity_table

    rnd = random.Random(11)
    names = sorted(html.entities.html5)
    legacy = [n for n in names if not n.endswith(";")]
    refs = [f"&{n}" for n in names]  # all of them
    refs += [f"&{rnd.choice(legacy)}{rnd.choice(['x', 'it', ';', ' ', '1;', 'é', '&amp', ''])}" for _ in range(400)]
    refs += [f"&{n[:rnd.randint(1, len(n))]}{rnd.choice(['', ';', 'q', '='])}" for n in rnd.choices(names, k=400)]
    refs += [f"&#{rnd.choice(['', 'x', 'X'])}{rnd.choice(['', '0', '000'])}{rnd.randint(0, 200)}{rnd.choice(['', ';'])}" for _ in range(400)]
    refs += [f"&#{n};" for n in (0, 9, 11, 13, 31, 127, 128, 129, 159, 160, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10 ** 30)]
    refs += ["&", "&;", "&#;", "&#x;", "&#xZ;", "& amp;", "&" + "a" * 50, "&" + "n" * 31 + ";", "&notin;", "&notit;", "&amp;lt;"]
    texts = refs + ["a " + rnd.choice(refs) + rnd.choice(["", "b", "&lt"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.x for r in df.select("i", decode_references(F.col("t"), entity_table()).alias("x")).collect()}
    bad = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not bad, (len(bad), bad[:5])
