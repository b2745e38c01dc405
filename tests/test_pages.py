"""Trees, articles and Markdown of pages that are made of known parts."""

import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import codec, dom
from webloom.functions import html as H


def prose(n, word="word"):
    """About n characters of sentences."""
    one = f"This {word} sentence has some commas, enough of them, and ends here. "
    return (one * (n // len(one) + 1))[:n].strip()


def page(body, head=""):
    return f"<html><head><title>T</title>{head}</head><body>{body}</body></html>"


def article(html):
    title, byline, date, content, fallback = H.article_of(html)
    assert not fallback
    return H.page_of(html)[5]


BODY = "".join(f"<p>{prose(300, f'p{i}')}</p>" for i in range(5))
TEXT = "\n\n".join(prose(300, f"p{i}") for i in range(5))


def test_a_teaser_does_not_win():
    got = article(page(f"<article><p>{prose(175, 'teaser')}</p></article><div id='x'>{BODY}</div>"))
    assert TEXT in got


def test_siblings_are_joined():
    got = article(page(f"<div class=wrap><div class=s><p>{prose(600, 'one')}</p><p>{prose(500, 'two')}</p></div><div class=s><p>{prose(600, 'three')}</p><p>{prose(400, 'four')}</p></div></div>"))
    assert all(w in got for w in ("one", "two", "three", "four"))


@pytest.mark.parametrize("names", ["main social-article", "related-content body", "share story", "content"])
def test_names_that_only_sound_unlikely(names):
    assert TEXT in article(page(f"<div class='{names}'>{BODY}</div>"))


@pytest.mark.parametrize("names", ["sidebar", "comments", "related", "social share", "cookie-banner", "site-footer"])
def test_unlikely_parts_go(names):
    got = article(page(f"<div id=a>{BODY}</div><div class='{names}'><p>{prose(160, 'clutter')}</p></div>"))
    assert TEXT in got and "clutter" not in got


def test_heading_in_the_articles_header_stays():
    got = article(page(f"<header><h1>Site</h1><a href=/>home</a></header><article><header><h1>Own head</h1></header>{BODY}</article>"))
    assert got.startswith("# Own head\n\n" + TEXT) and "Site" not in got


def test_a_page_within_a_form():
    got = article(page(f"<form action=x><input type=hidden><div id=c>{BODY}</div><button>Send</button></form>"))
    assert TEXT in got


def test_relaxed_rules_when_little_is_left():
    """All text stands in parts with unlikely names: the rules that drop them are given up."""
    assert TEXT in article(page(f"<div class=sidebar>{BODY}</div>"))


def test_link_lists_and_controls_go():
    links = "<ul>" + "".join(f"<li><a href=/{i}>A link to somewhere {i}</a></li>" for i in range(12)) + "</ul>"
    got = article(page(f"<article>{BODY}{links}<div><input><input><select><option>pick</select></div><p>{prose(200, 'last')}</p></article>"))
    assert TEXT in got and prose(200, "last") in got and "somewhere" not in got and "pick" not in got


def test_lists_and_tables_of_the_text_stay():
    got = article(page(f"<article>{BODY}<ul><li>first point<li>second <a href=/x>point</a></ul><table><tr><th>k<th>v<tr><td>a<td>1</table></article>"))
    assert "- first point\n- second [point](/x)" in got and "| k | v |\n| --- | --- |\n| a | 1 |" in got


def test_divisions_without_paragraphs():
    got = article(page(f"<div id=a><div>{prose(700, 'one')}<br><br>{prose(700, 'two')}</div></div><div>short</div>"))
    assert "one" in got and "two" in got and "short" not in got


def test_meta_data():
    data = '<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "author": [{"name": "Ann"}, {"name": "Bo"}], "datePublished": "2024-01-02"}]}</script>'
    assert H.article_of(page(BODY, data))[1:3] == ("Ann, Bo", "2024-01-02")
    assert H.article_of(page(BODY, "<meta name=author content='Cy'><meta property=article:published_time content=2023-02-03>"))[1:3] == ("Cy", "2023-02-03")
    assert H.article_of(page(f"<p class=byline>By  Di</p>{BODY}"))[1:3] == ("By Di", None)
    assert H.article_of(page(BODY, '<script type="application/ld+json">{broken</script>'))[1:3] == (None, None)


def test_what_is_not_readable():
    for body in ("<p>hi</p>", "".join("<p>short one</p>" for _ in range(200)), f"<ul><li><p>{prose(300)}</p></li></ul>", ""):
        html = page(body)
        assert H.article_of(html) == ("T", None, None, html, True)
    raw = H.page_of(page(BODY), raw=True)
    assert raw[4] is False and raw[3] == page(BODY)


@pytest.mark.parametrize(
    ("html", "md"),
    [
        ("<ul><li>a</li><ul><li>b</li></ul><li>c</ul>", "- a\n   - b\n- c\n"),
        ("<ol start=3><li>a<p>b</p><ul><li>x<li>y</ul><li>z</ol><p>after", "3. a\n\n   b\n   - x\n   - y\n4. z\n\nafter\n"),
        ("<ul><li>a</ul><ul><li>b</ul>", "- a\n\n- b\n"),
        ("<ul>stray<li>a</ul>", "stray\n\n- a\n"),
        ("<table><tr><td>1<td>2<tr><td><table><tr><td>in<td>ner</table><td>4</table>", "1\n\n2\n\n| in | ner |\n| --- | --- |\n\n4\n"),
        ("<table><caption>cap</caption><tr><th>a<th>b|c<tr><td>1<br>2<td><b>x</b> <a href=u>l</a></table>", "| a | b\\|c |\n| --- | --- |\n| 1 2 | **x** [l](u) |\n\ncap\n"),
        ("<table><tr><td><p>one</p><p>two</p><td>three</table>", "one\n\ntwo\n\nthree\n"),
        ("<form><p>page</p><button>ok</button></form>", "page\n\nok\n"),
        ("<blockquote><p>q</p><ul><li>i</ul><p>r</blockquote>x", "> q\n>\n> - i\n>\n> r\n\nx\n"),
        ("<pre><code class=language-py>a\n b ```</code></pre>", "````py\na\n b ```\n````\n"),
        ("<p>b <code>c`d</code> <i>it </i>x<hr>", "b `` c`d `` *it* x\n\n---\n"),
        ("<a href=u><div>x</div><div>y</div></a>", "[x](u)\n\n[y](u)\n"),
        ("<b>1<p>2</b>3</p>4", "**1**\n\n**23**\n\n**4**\n"),
        ("<p>a<table><tr><td>c</p>d<td>e</table>f", "a\n\n| cd | e |\n| --- | --- |\n\nf\n"),
        ("<h2>a<br>b</h2><b></b><p> </p>", "## a b\n"),
        ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n\nb\n\nc\n\nd\n"),
        ("x<svg><g/><text>no</text></svg>y<noscript>n</noscript><textarea>t &amp; <b></textarea>", "xy\n\nt & <b>\n"),
        ("a <!-- <p> --> b <![CDATA[c]]> d <? e ?> f < g </> h", "a b d f < g h\n"),
        ("<a href=u>x <table><tr><td>y <a href=v>z</a></table></a>", "[x](u)\n\n[y z](u)\n"),
        ("<img src=i alt='a\nb'><a>plain</a><a href=''>none</a>", "![a b](i)plainnone\n"),
        ("<head><title>t</title><p>no end of head", "no end of head\n"),
        ("<p a='1' a=2 b c = d / e>x<BR/>y</P>", "x\ny\n"),
    ],
)
def test_markdown(html, md):
    assert H.markdown_of(html) == md


def test_open_ends_are_left_out():
    assert H.markdown_of("a<b title='x") == "a\n"
    assert H.markdown_of("a<!-- b") == "a\n"
    assert H.markdown_of("a<script>b") == "a\n"


def test_tree():
    root = dom.parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<div>y</div>")
    shown = dom.serialized([root])
    assert shown == "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><p>x</p><div>y</div>"
    assert dom.serialized([dom.parse(shown)]) == shown


@pytest.mark.parametrize("html", ["<div>" * 30_000 + "</x>" * 30_000, "<table><tr><td>x" * 10_000, "<div>" * 16_000 + "<li>a" * 16_000, "<blockquote>a" * 10_000, "<ul><li>a" * 13_000, "<b>a" * 26_000, "<!--" * 33_000, '<a "' * 33_000, "<" * 133_000, "<!" * 66_000, "<p><b>" * 26_000, "<td><tr>" * 20_000, "</p>" * 33_000, "<a href=x><div>" * 10_000, "<h1><ul>" * 16_000, "".join(f"<a href={i}><table><tr><td>x" for i in range(4_000)), "<p>" + "A sentence, of words. " * 9 + "</p>" + "<p>short, one.</p>" * 8_000])
def test_linear(html):
    """A hundred kilobytes of whatever take a second, not minutes."""
    start = time.perf_counter()
    H.page_of(html)
    assert time.perf_counter() - start < 8


def test_long_texts_go_to_python_by_the_hundred(spark):
    """Pages and bodies do not wait in Arrow batches of ten thousand rows."""
    row = spark.createDataFrame([("<p>x</p>", bytearray(b"x"), "latin1")], "html string, body binary, charset string")
    plan = lambda c: row.select(c.alias("c"))._jdf.queryExecution().executedPlan().toString()
    for c in (H.html_to_markdown(F.col("html")), H.extract_article(F.col("html")), H.read_page(F.col("html"), F.lit(False)), codec.decode_body(F.col("body"), F.col("charset"))):
        assert "BatchEvalPython" in plan(c) and "ArrowEvalPython" not in plan(c)


def test_bodies_that_need_no_table_stay_out_of_python(spark):
    row = spark.createDataFrame([(bytearray(b"caf\xe9"), None), (bytearray(b"caf\xe9"), "latin1"), (None, "latin1"), (bytearray("é".encode()), "utf8")], "body binary, charset string")
    assert [r[0] for r in row.select(codec.decode_body(F.col("body"), F.col("charset"))).collect()] == ["caf�", "café", None, "é"]
