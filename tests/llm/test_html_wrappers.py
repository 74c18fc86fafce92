"""Class words of a wrapper don't cut the article in it; those of real side blocks still do."""

import pytest

from tidemark.llm import html_text

TEXT = "The long text of the article goes on for a while, with many words and no link at all. " * 5
MORE = "Its second paragraph is just as long and says something else about the same matter. " * 4
BODY, WANT = f"<p>{TEXT}</p><p>{MORE}</p>", f"{TEXT.strip()}\n{MORE.strip()}"
SIDE = "<div class='sidebar'><p>Some other words stand here.</p></div>"
COMMENTS = "<div class='comments'>" + f"<p>I disagree with this text. {TEXT}</p>" * 6 + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='site has-sidebar'><article>{BODY}</article></div>",
        f"<article class='post ad-free'>{BODY}</article>",
        f"<div class='site has-sidebar'><div id=content>{BODY}</div>{SIDE}</div>",
        f"<div class='no-header'><div class='ad-free'>{BODY}</div>{SIDE}</div>",
        f"<p>Imprint</p><div class='comments-open'><article class='widget'>{BODY}</article></div>",
        f"<main><div class='with-sidebar'>{BODY}</div></main>{SIDE}",
        # Blocks that aren't the article go, also where they are longer.
        f"<article>{BODY}</article>{COMMENTS}",
        f"<div class='site has-sidebar'><div id=content>{BODY}</div>{COMMENTS}{SIDE}</div>",
        f"<div id=content>{BODY}</div><div class='related'><article><p>A teaser</p></article></div>",
        f"<article>{BODY}</article><div class='cookie-consent'><p>{MORE * 5}</p></div>",
    ],
)
def test_wrappers(page):
    assert html_text.extract(f"<html><body>{page}</body></html>") == WANT


def test_nested_marks_end_in_time():
    assert html_text.extract("<div class=ad>" * 3_000 + TEXT) == TEXT.strip()
