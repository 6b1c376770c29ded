"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per block of text.
A line's ratio is its characters over its tags (0 in menus, forms, adverts and
other page furniture).  Ratios are smoothed with a Gaussian along the page and clustered
by a threshold, their standard deviation.  Lines at or over it are content and choose, on
every page, the regions they stand in: the innermost block, or the whole article
(``article``, or ``main`` outside its articles) around it.  An article is chosen by
its own text only: one of its lines must reach the threshold unsmoothed too, so a long neighbour
doesn't lift a teaser.  Every line of a chosen region that isn't furniture is kept, short ones too.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noteflare.llm.common import arrow_stage, with_fields

FEED = 1 << 16
SIGMA = 1.0
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset(
    "head title nav footer aside form script style noscript template iframe object svg canvas button select "
    "textarea dialog menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr "
    "notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer comment comments "
    "commentlist disqus reply replies related share sharing social newsletter subscribe popup modal overlay signup "
    "login skip".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Lines(HTMLParser):
    """Lines of a page: [text pieces, tags, furniture?, region] in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []      # (tag, furniture?, article number, region number)
        self.places = {}    # places in ``open`` by tag
        self.blocks = []    # places in ``open`` of elements that are no inline ones
        self.lines = []     # finished: (text, tags, furniture?, article, region)
        self.pieces, self.tags = [], 0
        self.regions = 0
        self.mains = {0}    # article numbers that an <article> inside replaces

    def _state(self):
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def _flush(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, self.tags, *self._state()))
            self.tags = 0
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br" or tag == "hr":
            self.pieces.append(" ")
        if tag in VOID:
            return
        furniture, article, region = self._state()
        if tag not in INLINE:
            self._flush()
            self.regions += 1
            if (tag == "article" and article in self.mains) or (tag == "main" and not article):
                article = self.regions
                if tag == "main":
                    self.mains.add(article)
            if tag not in ("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr", "td", "th"):
                region = self.regions
        own = tag in FURNITURE_TAGS or (tag == "header" and not article)
        if not own and attrs and tag not in ("html", "body"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    own = own or not FURNITURE_WORDS.isdisjoint(_SPLIT.split(value.lower()))
                elif name == "role" and value:
                    own = own or value.lower() in FURNITURE_ROLES
                elif name == "hidden":
                    own = True
        if own and tag in INLINE:
            self._flush()
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, furniture or own, article, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.places.get(tag):  # nothing of this name is open
            return
        depth = self.places[tag][-1]
        # An unclosed inline tag ends with its block; an inline end tag never closes a block.
        if tag in INLINE and self.blocks and self.blocks[-1] > depth:
            return
        if tag not in INLINE or self.open[depth][1] != (self.open[depth - 1][1] if depth else False):
            self._flush()
        while len(self.open) > depth:  # every element is closed once, so a page costs its number of tags
            gone = self.open.pop()[0]
            self.places[gone].pop()
            if gone not in INLINE:
                self.blocks.pop()

    def handle_data(self, data):
        self.pieces.append(data)

    def finish(self):
        self.close()
        self._flush()
        return self.lines


def _smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the page's ends are padded with their values."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    """The page's main text; empty when there is none."""
    parser = _Lines()
    html = html or ""
    for i in range(0, len(html), FEED):
        parser.feed(html[i:i + FEED])
    lines = parser.finish()
    usable = [not line[2] for line in lines]
    if not any(usable):
        return ""
    ratio = np.array([len(line[0]) / max(1, line[1]) if ok else 0.0 for line, ok in zip(lines, usable)])
    level = _smooth(ratio)
    least = min(level.std(), level[usable].max())
    content = (level >= least) & np.array(usable)
    region = [line[3] or line[4] for line in lines]  # an article's number is that of its element
    own = {r for r, x in zip(region, ratio) if x >= least}
    scored = [(r, line[3]) for r, line, c in zip(region, lines, content) if c]
    chosen = {r for r, article in scored if not article or r in own} or {r for r, _ in scored}
    return " ".join(line[0] for line, ok, r in zip(lines, usable, region) if ok and r in chosen)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Every input row with (text, n_chars) appended: main text and its code points.

    Null and empty html have an empty text.  Input columns of those names are
    replaced (other than the html's); an empty table gives an empty result.
    """
    src = pages.select(*[c for c in pages.columns if c == html_col or c not in (text_col, "n_chars")])
    at, names = src.columns.index(html_col), [*src.columns, text_col, "n_chars"]

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return arrow_stage(src, run, with_fields(src.schema, f"{text_col} string, n_chars long"))
