import time

import pytest

from fieldtally.llm.html_text import extract, main_text

LONG = "It was the best of times and the worst of times, and all of it was in the book that he had with him."

CASES = [
    (None, ""),
    ("", ""),
    ("plain text without tags that is all of the page and it was to be kept by the one who reads", "plain text without tags that is all of the page and it was to be kept by the one who reads"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Of.</article><footer>end</footer>", f"T {LONG} Of."),
    ("<article><p>Yes.</p><p>No.</p></article>", "Yes. No."),
    (f"<main><p>a&amp;b&nbsp;&lt;c&gt;\n\t &#8364;</p><div class='ad box'>{LONG}</div></main>", "a&b <c> €"),
    (f"<article>x<b>y</b>z<br>w<section id=comments><p>{LONG}</section></article>", "xyz w"),
    (f"<article><p>one | two | three | four | five | six | seven</p></article><div>{LONG}</div>", "one | two | three | four | five | six | seven"),
    (f"<div class=cookie-notice>{LONG}</div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p></div>", f"Head {LONG} Short."),
    (f"<p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG}</aside>", LONG),
    (f"<p>{LONG}</p><ul><li><a href=1>first link of all</a><li><a href=2>second link of all</a></ul>", LONG),
    (f"<article><p>{LONG}</p><script>var a = '</p>{LONG}';</script><style>p{{}}</style><!-- {LONG} --></article>", LONG),
    (f"<article><p>{LONG}</p>" + "<p>unclosed <i>tags <b>everywhere", f"{LONG} unclosed tags everywhere"),
    (f"<article><p>{LONG}</p><table><tr><td>1<td>2</table><footer>by me</footer></article>", f"{LONG} 1 2"),
    (f"<html><head><title>t</title><meta name=x><body><article><header><h1>H of it</h1></header>{LONG}</article>", f"H of it {LONG}"),
    ("<p hidden>secret words</p><article><p style='display: none'>gone</p>here</article>", "here"),
    ("<article>a < b and c > d</article>", "a < b and c > d"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_broken_pages_take_linear_time():
    began = time.process_time()
    for page in ("<a " * 60000, "<script " * 60000, "<svg x " * 60000, "<p>" * 60000 + "x", "<div>" * 60000 + "x", '<a href="x' * 30000, "<!--" * 30000, "<" * 60000, "<nav>" * 30000 + "</p>" * 30000):
        main_text(page)
    assert time.process_time() - began < 30


def test_table(spark):
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(CASES)] + [(1, None, CASES[3][0], None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = [tuple(r) for r in extract(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, u, main_text(p), len(main_text(p))) for i, u, p, _ in rows), key=repr)
    assert extract(df.limit(0)).count() == 0


POLISH = "Wczoraj wieczorem dzieci poszły nad rzekę, gdzie stary rybak opowiadał im długie historie dawnych czasów."
CHINESE = "昨天晚上孩子们去了河边，老渔夫在那里给他们讲了很久以前的故事，大家都听得非常入神。"


def test_other_languages_without_marked_article():
    for text in (POLISH, POLISH * 3, CHINESE, CHINESE * 6):
        assert main_text(f"<nav><a href=x>x</a></nav><div><p>{text}</p><p>{text}</p></div><footer>{text}</footer>") == f"{text} {text}"
    keywords = "red | green | blue | yellow | orange | violet | black | white | brown | grey"
    assert main_text(f"<p>{LONG}</p><p>{LONG}</p><div>{keywords}</div>") == f"{LONG} {LONG}"


def test_long_block_with_copyright_sign():
    assert main_text(f"<p>{LONG} The sign © is in it. {LONG} {LONG}</p><p>© 2020 by the one who has all of the rights in it</p>").count("©") == 1


def test_names_of_wrappers():
    article = f"<article><p>{LONG}</p><div class=share>{LONG}</div></article>"
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "side-by-side", "share-enabled", "search", "sidebar-page"):
        assert main_text(f"<div class='{name}'>{article}</div>") == LONG
        assert main_text(f"<div id='{name}'><div>{article}</div></div><p class=ad>{LONG}</p>") == LONG
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "sidebar-page"):
        assert main_text(f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div><div class=comment-list>{LONG}</div>") == f"{LONG} {LONG}"
    for name in ("sidebar", "sidebar-inner", "post-comments", "comment-list", "a widget b"):
        assert main_text(f"<p>{LONG}</p><div class='{name}'><p>{LONG}</p></div>") == LONG
        assert main_text(f"<article><p>{LONG}</p></article><div class='{name}'><article>{LONG}</article></div>") == LONG
