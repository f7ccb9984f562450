import html
import re

import pytest

from tesoro.llm import html_text as H
from tesoro.llm.common import prepare


def text(page, path=None):
    return H.extract(H.blocks(page), path)


PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{}</style><script>var a="</p><p>no</p>";</script>
</head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div id="sidebar2"><p>%s</p></div><form><p>Search</p><input></form>
<article class="post-12"><h1>Head&shy;line</h1><p>One  two\n<b>three</b>&nbsp;<a href="x">link</a>.<p>Second &lt;b&gt; &eacute;
<br>line</p><div class="ad">Buy</div><ul><li>a<li>b</ul><aside>aside</aside><blockquote>Quote</blockquote>
<table><tr><td>c<td>d</table><section class=comments><p>%s</p></section><p hidden>no</p><p style="display: none">no</p></article>
<footer>&copy; site</footer></body></html>""" % ("side " * 90, "comment " * 90)


def test_article_without_what_surrounds_it():
    assert text(PAGE).split("\n") == ["Head­line", "One two three link.", "Second <b> é line", "a", "b", "Quote", "c", "d"]


@pytest.mark.parametrize("page,want", [
    ("", ""), ("   ", ""), ("plain text", "plain text"), ("a < b and c > d", "a < b and c > d"),
    ("<p>unclosed <b>bold", "unclosed bold"), ("<p>a</p></div></p>b", "a\nb"), ("<!-- open <p>x", ""),
    ("<p title='a>b'>q</p>", "q"), ('<p title="broken>text</p>', "text"), ("<script>x</SCRIPT >y", "y"), ("<script>never ends", ""),
    ("<p>&#x41;&#66;&unknown;&amp;lt;</p>", "AB&unknown;&lt;"), ("<P CLASS=X>a<P>b", "a\nb"), ("<nav>n</nav>", ""),
    ("<body><nav>menu<p>x</nav><p>kept</body>", "kept"), ("<div><div>in</div> out</div>", "in\nout")])
def test_odd_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page,want", [
    ('<article title="The hidden costs"><p>kept</p></article>', "kept"), ('<p title="hidden gem">kept</p>', "kept"),
    ('<div data-hidden="false">kept</div>', "kept"), ('<section data-id="share">kept</section>', "kept"),
    ('<a href="/blog/hidden-gems">the guide</a>', "the guide"), ('<a href="/item?id=ad">kept</a>', "kept"),
    ("<a href=/x?role=search>kept</a>", "kept"), ("<p title=hidden>kept", "kept"), ("<p hidden/>no", ""), ("<p HIDDEN=''>no", ""),
    ("<p x='>' hidden>no", ""), ("<p aria-hidden = 'TRUE'>no", ""), ("<p id=a id=ad>kept", "kept"), ("<p =hidden>kept", "kept")])
def test_attributes_are_read_by_their_whole_name(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page,want", [
    ("<a " * 300_000, None), ("<a '" * 200_000, None), ('<a "' * 200_000 + ">", None), ("<!" * 300_000, None),
    ("<div>" * 50_000 + "in" + "</div>" * 50_000 + "after", "in"), ("<div>x" * 50_000, None),
    ("<b>" * 50_000 + "</i>" * 50_000 + "x", "x"), ("<script>" + "</script " * 200_000, ""),
    ("<p>" + " " * 500_000 + "x" + "<!-- " * 100_000, "x"), ("<a b='>' c=\"" * 50_000, None)])
def test_broken_and_deep_pages_take_linear_time(page, want):
    import time
    began = time.process_time()
    found = text(page)
    assert time.process_time() - began < 4
    assert want is None or found == want


LONG = " ".join(f"sentence {i} of the story" for i in range(40))


@pytest.mark.parametrize("opening", [
    "article class='long-form'", "article class='post category-search tag-social'", "div class='content has-sidebar'",
    "main class='no-sidebar'", "article class='entry comments-open'", "div class='wrap search'", "div id=widget", "article class='post share'",
    "main class=form", "div class='with-comments'", "span class=promo"])
def test_an_article_in_an_element_with_a_marked_name(opening):
    page = f"<body><div class='page-header'><p>Site</p></div><{opening}><h1>Head</h1><p>{LONG}</p><div class='ad'>Buy</div></{opening.split()[0]}>"
    assert LONG in text(page) and "Buy" not in text(page)


@pytest.mark.parametrize("name", ["ad", "sidebar2", "site-sidebar", "cookie-notice", "commentList comments", "comments-area", "adContainer",
                                  "search-form", "social-share", "related"])
def test_marked_content_beside_or_in_main_text(name):
    page = f"<body><article><h1>Head</h1><p>{LONG}</p><div class='{name}'><p>noise</p></div></article><div id='{name}'><p>noise {LONG}</p></div>"
    assert text(page) == f"Head\n{LONG}"
    page = f"<body><div class=content><p>{LONG}</p><div class='{name}'><p>noise {LONG} {LONG}</p></div></div>"
    assert text(page) == LONG
    page = f"<div class=entry><p>{LONG}</p></div>" + "<article class=comment><p>noise</p></article>" * 9
    assert text(page) == LONG


def test_an_article_in_two_containers(spark):
    parts = [f"intro {LONG[:400]}", f"rest {LONG[:600]}"]
    page = "<body><div class=wrap><div class=intro><p>%s</p></div><div class=rest><p>%s</p></div></div><p>x</p>" % tuple(parts)
    assert text(page) == "\n".join(parts)
    prepare(spark)
    table = spark.createDataFrame([(i, "http://a/", page) for i in range(3)], "page_id long, url string, html string")
    assert {(r["text"], r["path"]) for r in H.extract_pages(table).collect()} == {("\n".join(parts), "html>body>div.wrap")}


def test_consensus_of_a_host_beats_a_page_of_its_own(spark):
    prepare(spark)
    body = "<div class='story'><p>%s</p></div><div class='extra'><p>%s</p></div>"
    pages = [(i, "http://A.example:80/%d" % i, body % ("main text of the page %d" % i, "short"), 0) for i in range(5)]
    pages += [(5, "https://user@a.example/x", body % ("tiny", "a long passage that this one page would choose by itself"), 0),
              (6, "http://a.example/", "<div class=other><p>no story here</p></div>", 0), (7, None, "<p>no url</p>", 0),
              (8, "http://b.example/", None, 0), (9, "http://b.example/", "", 0), (6, "http://a.example/", "<p>again", 0),
              (10, "http://b.example/", "<p>" + "long " * 40000, 0), (None, "nonsense", "<p>x</p>", 0)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, path int")
    found = {(r["page_id"], r["url"], r["text"][:60]) for r in H.extract_pages(table).collect()}
    assert (0, "http://A.example:80/0", "main text of the page 0") in found
    assert (5, "https://user@a.example/x", "tiny") in found
    assert (6, "http://a.example/", "no story here") in found and (6, "http://a.example/", "again") in found
    assert (7, None, "no url") in found and (8, "http://b.example/", "") in found and (9, "http://b.example/", "") in found
    assert len(found) == len(pages)
    assert {r["host"]: r["votes"] for r in H.host_paths(table).collect()}["a.example"] == 5
    assert H.extract_pages(table.limit(0)).count() == 0


def test_query_finds_the_articles_of_the_whole_table(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    want = {}
    for page, source in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall():
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.search(r"<article>(.*?)</article>", source, re.S)[1])
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts)
        want[page] = "\n".join(x for x in lines if x)
    found = H.op1_html_extraction(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in found} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found)
