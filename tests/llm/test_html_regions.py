"""Smoothed ratios choose the regions, with articles on the page or without."""

import pytest

from noteflare.llm import html_extract

WORDS = "Story part {0} goes on with a good many plain words about one thing and then another, as stories do. "
PARTS = [(WORDS.format(k) * 3).strip() for k in range(3)]
STORY = "<div class=story><h1>The story</h1>" + "".join(f"<p>{p}</p>" for p in PARTS) + "<p>Short end.</p></div>"
WANT = " ".join(["The story", *PARTS, "Short end."])
CARDS = "".join(f'<article><h3><a href="/{i}">Teaser {i}</a></h3><p>Short teaser. <a href="/{i}">More</a></p></article>' for i in range(4))


@pytest.mark.parametrize("body", [STORY + CARDS, CARDS + STORY, CARDS + STORY + CARDS, f"<main>{STORY}{CARDS}</main>"])
def test_story_beside_cards(body):
    assert html_extract.main_text(f"<body><nav><a href=/>Home</a></nav>{body}<footer>me</footer></body>") == WANT


def test_content_outside_an_article_is_kept():
    page = f"<body><article><h1>Title</h1><p>{PARTS[0]}</p><p>End.</p></article><div><p>{PARTS[1]}</p></div></body>"
    assert html_extract.main_text(page) == f"Title {PARTS[0]} End. {PARTS[1]}"
