import html
import re
import time

import duckdb
import pytest

from quarry.llm import main_text as m

LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
NAV = "<nav><a href=/>Home</a><a href=/b>Blog</a><a href=/c>Contact us today</a></nav>"
#: Layouts that the labelled table doesn't hold, with what a reader would call the article.
PAGES = {
    "elements": (f"<html><body class='has-sidebar single'><header><a href=/>My Site</a><p>Just another weblog tagline</p></header>{NAV}<div class=cookie-banner><p>{LONG} cookies</p><button>OK</button></div><main><article><h1>Title here</h1><p>{LONG}</p><p>No.</p><p>{LONG} {LONG}</p><form><p>Sign up</p><input><label>Email</label></form><p>{LONG}</p><aside>Ad {LONG}</aside></article><section id=comments><h2>3 Comments</h2><div class=comment><p>{LONG}</p></div></section></main><aside><h3>Popular</h3><p>{LONG}</p></aside><footer><p>Copyright 2020</p></footer></body></html>", ["Title here", LONG, "No.", f"{LONG} {LONG}", LONG]),
    "names": (f"<body><div id=header><h1>Site</h1><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div><div id=wrapper><div id=sidebar-left><h3>Links</h3><p>{LONG}</p></div><div id=content><h1>Real title</h1><p>{LONG}</p><p>Short.</p><h2>Sub</h2><p>{LONG}</p><ul><li>one item</li><li>two item</li></ul><p>{LONG}</p></div></div><div id=footer>All rights reserved. <a href=x>Privacy</a></div></body>", ["Real title", LONG, "Short.", "Sub", LONG, "one item", "two item", LONG]),
    "bare": (f"<body><div><a href=1>Home page</a> <a href=2>News</a></div><div><h2>Title words here</h2><div>{LONG}</div><div>{LONG}</div><div>Tiny.</div><div>{LONG}</div></div><div><a href=1>About</a> | <a href=2>Terms of use</a></div><div>&copy; 2021 Foo Corp</div></body>", ["Title words here", LONG, LONG, "Tiny.", LONG]),
    "form around": (f"<body><form id=f><div class=topnav><a href=x>Home</a></div><div class='article-body'><h1>T</h1><p>{LONG}</p><p>a <script>var a='<p>no</p>';</script>x</p></div><div class='widget social'>Share this</div></form></body>", ["T", LONG, "a x"]),
    "unclosed": (f"<body><nav><ul><li><a href=1>A<li><a href=2>B</ul><article><h1>T<p>{LONG}<p>{LONG}<p>ok<footer>foot", ["T", LONG, LONG, "ok"]),
    "comments": (f"<body><article><h1>T</h1><p>{LONG}</p><section><h2>Comments (2)</h2><article><p>{LONG} {LONG}</p></article><article><p>{LONG}</p></article></section></article></body>", ["T", LONG]),
    "with sidebar": (f"<body><div class='page-with-sidebar'><div class='layout sidebar-right'><h1>T</h1><p>{LONG} {LONG}</p><p>{LONG}</p></div></div></body>", ["T", f"{LONG} {LONG}", LONG]),
    "notices": (f"<body><div role=alert>Our offices are closed today.</div><div class=notice><p>{LONG}</p></div><p class=copyright>x y</p><div class=story><h1>T</h1><p>a<br>b &amp; c&nbsp;d &#8211; e &lt;b&gt;</p><p style='display:none'>gone</p><p>{LONG}</p></div><div class='ad-slot'>{LONG}</div><div class=advertisement>{LONG}</div></body>", ["T", "a b & c d – e <b>", LONG]),
    "related": (f"<body><div class=container><section><h1>T</h1><p>{LONG}</p><p>x y z.</p><p>{LONG}</p></section><section><h2>Related stories</h2><ul><li><a href=1>Foo bar baz</a></li><li><a href=1>Foo bar two</a></li></ul></section></div></body>", ["T", LONG, "x y z.", LONG]),
    "table": (f"<table><tr><td><a href=1>Home</a><br><a href=2>About</a><br><a href=4>More things</a></td><td><h1>T</h1><p>{LONG}<p>{LONG}<p>small</td></tr></table>", ["T", LONG, LONG, "small"]),
    "no article": ("<body><nav><a href=1>x</a></nav><footer>c</footer></body>", []),
    "cut": (f"<article><p>{LONG}</p><p>a < b and c<d></d> &am<p cla", [LONG, "a < b and c &am"]),
    "head left open": (f"<head><title>t</title><meta name=x><article><p>{LONG}</p><!-- <p>no</p> --><p title='a > b'>yes</p></article>", [LONG, "yes"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, want = PAGES[name]
    assert m.main_blocks(page, m.trained()) == want


def test_whole_table_against_its_articles(spark):
    """The given pages mark their article by an element: what a plain reading of it gives is what the tree finds."""
    from quarry.llm.queries import op13_main_text

    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    want = []
    for page, url, text in rows:
        body = re.sub(r"<[a-z/]*$", "", re.search(r"<article>(.*?)(?:</article>|<footer|$)", text, re.S)[1])
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>", body))
        said = "\n".join(p for p in parts if p)
        want.append((page, url, said, len(said)))
    assert sorted(map(tuple, op13_main_text(spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_nulls_clashes_and_lengths(spark):
    big = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, None), (1, None), (None, ""), (2, big), (3, "no markup"), (4, "<" * 50_000), (5, "<div>" * 50_000 + LONG), (6, "<p hidden>" * 20_000 + "</div>"), (7, "<script>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'x' AS text", "2 AS n_chars", "3 AS words")
    began = time.time()
    got = m.with_main_text(pages)
    assert got.columns == ["page_id", "html", "words", "text", "n_chars"]
    found = {x.page_id: x.text for x in got.collect()}
    assert len(found) == 8 and found[1] == "" and found[None] == "" and found[2] == "\n".join([LONG] * 20_000) and found[5] == LONG and found[7] == ""
    assert time.time() - began < 300
    assert m.with_main_text(pages.where("page_id > 99")).count() == 0


def test_tree_learns_and_repeats_itself():
    x, y = m.labelled()
    assert (m.trained().main(x) == y).mean() > 0.995 and m.trained().main(m.features([])).tolist() == []
    again = m.Tree(x, y)
    assert again.cut.tolist() == m.trained().cut.tolist()
