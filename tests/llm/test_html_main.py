import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm.html_main import extract, main_text

ARTICLE = "<h1>Title here</h1><p>First &amp; foremost&nbsp;text <a href=x>link</a>\n  with  space.<br>Next.<p>Second <b>bold</b> one.</p><ul><li>one</li><li>two</ul>"
WANT = "Title here\n\nFirst & foremost text link with space. Next.\n\nSecond bold one.\n\none\n\ntwo"
AROUND = ["<nav><a href=a>Home</a></nav>", "<div class='side-bar sidebar'><p>Words of a side bar that go on.</p></div>", "<header><h2>Site</h2></header>",
          "<footer>Foot note with quite some words.</footer>", "<div id=\"cookie-notice\">We use cookies.</div>", "<form><input name=q><label>Search</label></form>",
          "<script>if (a<b) document.write('<p>no</p>')</script>", "<style>p{}</style>", "<section class=comments><article><p>A reader says a lot here.</p></article></section>",
          "<aside>Aside words.</aside>", "<!-- <p>hidden</p> -->", "<div class=ad>Buy this thing now or never again.</div>", "<noscript>Turn it on</noscript>"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content><div>{}</div></div>"])
@pytest.mark.parametrize("part", AROUND)
def test_boilerplate_goes_and_the_article_stays(wrap, part):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{part}{wrap.format(ARTICLE)}{part}</body></html>"
    assert main_text(page) == WANT


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p", ""), ("plain text", "plain text"), ("<body></body>", ""), ("<p>a<p>b", "a\n\nb"),
                                       ("<article><p>cut off &am", "cut off &am"), ("<article><p>x</p></article", "x"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
                                       ("<article><p title='a > b'>q</p><p data-x=\"1>2\">r</p>", "q\n\nr"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up")])
def test_odd_pages(page, text):
    assert main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/='\"abp &;!-", max_size=80))
def test_any_input_gives_a_text(page):
    out = main_text(page)
    assert out == out.strip() and "\n\n\n" not in out


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>para {i} " + "w " * 50 + "</p>" for i in range(4000)) + "</article>"
    assert main_text(page).count("\n\n") == 3999


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'c' as text", "0 as n_chars")
    assert sorted(extract(df).collect(), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_query_equals_template(spark):
    """The given pages share one template, so a plain pattern finds their article."""
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op5_main_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", m[1] if m else "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", lambda t: " " if t[0].startswith("<br") else "", b)).split()) for b in blocks]
        text = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, text, len(text))
