"""Main text of hand-made pages, odd markup, and the tables' pages against their known structure."""

import html
import re

import pytest

from aislefix.llm.html_text import blocks_of, main_text

LONG = "This is the text of the story that was told to all of us, and it is long enough to be sure of what it is. " * 3
LONG = LONG.strip()
OTHER = "It was not the first time that we had heard of the house on the hill, but it was the last of that year for us. " * 2
OTHER = OTHER.strip()


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("plain words only", ""),
    (page(f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{OTHER}</p></article>"), f"Title\n{LONG}\nShort.\n{OTHER}"),
    (page("<article><h1>Title</h1><p>Short.</p></article>"), "Title\nShort."),
    (page(f"<nav><ul><li><a href=/>Home</a><li><a href=/b>The story of the week and all that it is about</a></ul></nav><div id=content><h2>Head</h2><p>{LONG}<p>A bit.<p>{OTHER}</div><footer>All rights of the story</footer>"), f"Head\n{LONG}\nA bit.\n{OTHER}"),
    (page(f"<header>{LONG}</header><main><header><h1>Title</h1></header><p>{LONG}</p></main><aside>{OTHER}</aside>"), f"Title\n{LONG}"),
    (page(f"<main><p>{LONG}</p></main><section id='comments'><article class=comment><p>{OTHER}</p></article></section>"), LONG),
    (page(f"<div class='cookie-notice'>{OTHER}</div><article><p>{LONG}</p><div class='ad'>{OTHER}</div><p>End.</p></article>"), f"{LONG}\nEnd."),
    (page(f"<div class=ad>never closed<article><p>{LONG}</p></article>"), LONG),
    (page(f"<article><p>{LONG}</p><form><p>{OTHER}</p><input><select><option>One<option>Two</select></form><script>var x = '<p>{LONG}</p>'</script></article>"), LONG),
    (page(f"<article><p>a&amp;b &lt;i&gt; &eacute;&#233;&#xe9; and   the\n\tend of it</p><p>{LONG}</p></article>"), f"a&b <i> ééé and the end of it\n{LONG}"),
    (page(f"<article><p>one<br>two</p><p><b>bold <i>it</i></b>al</p><p>{LONG}</p><ul><li>first<li>second</ul></article>"), f"one two\nbold ital\n{LONG}\nfirst\nsecond"),
    (page(f"<article><!-- <p>{OTHER}</p> --><p title='a > b'>{LONG}</p><p hidden>{OTHER}</p><p style='display: none'>{OTHER}</p></article>"), LONG),
    (f"<article><p>{LONG}</p><p>cut off in the mid", f"{LONG}\ncut off in the mid"),
    (f"<article><p>{LONG}</p><p class='x", LONG),
    (f"<article><p>{LONG}</p><!-- open", LONG),
    (f"<article><p>{LONG}</p></div></b></nav><p>more</p></article>", f"{LONG}\nmore"),
    (page(f"<p>{LONG}</p><p><a href=/x>{OTHER}</a></p>"), LONG),
    (page("<p>a < b and c > d</p>" + f"<p>{LONG}</p>"), f"a < b and c > d\n{LONG}"),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_pages(number):
    source, want = CASES[number]
    assert main_text(source) == want


@pytest.mark.parametrize(
    "start", ["<article class='post has-sidebar'>", "<article class='post category-social'>", "<article class='with-sidebar'>", "<div id='content' class='with-sidebar'>"]
)
def test_parts_of_class_names_do_not_condemn_the_main_text(start):
    end = "</article>" if "article" in start else "</div>"
    assert main_text(page(f"{start}<p>{LONG}</p><div class='comment content'><p>{OTHER}</p></div>{end}")) == LONG
    assert main_text(page(f"<div class='sidebar-content'><p>{OTHER}</p></div>{start}<p>{LONG}</p>{end}")) == LONG


RUSSIAN = "Это был первый раз, когда дом на холме увидели все жители города, и никто потом уже не забыл того дня. " * 3
RUSSIAN = RUSSIAN.strip()


def test_pages_without_known_stop_words():
    links = f"<p><a href=/x>{RUSSIAN}</a></p>"
    assert main_text(page(f"<nav>{OTHER}</nav><div><h2>Дом</h2><p>{RUSSIAN}</p>{links}</div>")) == f"Дом\n{RUSSIAN}"
    middle = RUSSIAN[:150].strip()
    assert main_text(page(f"<article><h1>Дом</h1><p>{middle}</p>{links}</article>")) == f"Дом\n{middle}"
    assert main_text(page(f"<article><p>{RUSSIAN}</p>{links}</article>")) == RUSSIAN
    assert main_text(page(f"<div>{links}{links}</div>")) == ""


def test_very_long_and_deep_pages():
    many = page("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")
    assert main_text(many).count("\n") == 2999
    deep = "<div>" * 5000 + f"<p>{LONG}</p>" + "</div>" * 5000
    assert main_text(deep) == LONG
    assert main_text("<" * 50_000) == "" and len(blocks_of("<p" * 20_000)) <= 1


def test_frames(spark):
    from aislefix.llm.html_text import extract

    rows = [(1, "u", page(f"<p>{LONG}</p>"), 5), (1, "u", page(f"<p>{LONG}</p>"), 5), (2, None, None, 6), (None, "v", "", 7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_query_on_the_tables(spark, sf_dir):
    import __spark_entry__

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = __spark_entry__.queries()["op1_html_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        inside = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n", inside)))
        lines = (" ".join(html.unescape(x).split()) for x in inside.split("\n"))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


PROSE = "The cat sat on the mat and it was the best of all that we have seen in the year that is past. " * 2
TEXT = PROSE.strip()


@pytest.mark.parametrize(
    "body, lines",
    [
        (f"<h2 id=cookies-and-cream>Cookies and cream</h2><p>{PROSE}</p>", ["Cookies and cream", TEXT]),
        (f"<section id=related-work><p>{PROSE}</p></section>", [TEXT]),
        (f"<p class=market-share>{PROSE}</p>", [TEXT]),
        (f"<p>{PROSE}</p><ins class=ad>Buy now</ins><p>{PROSE}</p>", [TEXT, TEXT]),
        (f"<p>{PROSE}<span class=ad>Buy <b>now</b></span> and so on.</p>", [f"{TEXT} and so on."]),
        (f"<p>{PROSE}</p><x-comments class=comments><div><p>{PROSE}</p></div></x-comments><p>{PROSE}</p>", [TEXT, TEXT]),
        (f"<template>a<template>b</template>{PROSE}</template><p>{PROSE}</p>", [TEXT]),
        (f"<svg><svg/><text>{PROSE}</text></svg><p>{PROSE}</p>", [TEXT]),
        (f"<div class=comment-list><p>{PROSE}</p></div><p>{PROSE}<em>so</em></p>", [f"{TEXT} so"]),
        (f"<p>{PROSE}<span class=ad>never closed</p><p>{PROSE} on</p>", [TEXT, f"{TEXT} on"]),
    ],
)
def test_names_inline_adverts_and_nested_raw_elements(body, lines):
    assert main_text(f"<html><body><article>{body}</article></body></html>") == "\n".join(lines)
