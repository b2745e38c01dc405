"""HTML column functions: thin-page tests and titles in Spark expressions; article extraction and HTML to
Markdown, which expressions cannot hold, in UDFs over the standard library's parser."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import dom, markdown, readable, text_udf
from webloom.functions.text import WS, escape_yaml, shift_headings, trim, truncate_with_note

# Limits and marks of the page tests.
BODY_BYTES = 100
EXTRACT_CHARS = 50
OUTPUT_BYTES = 100_000
SPA_ROOTS = ('id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"')
RAW_FALLBACK_NOTE = "> Note: Readability extraction failed. Showing raw page conversion.\n\n"

# A tag's name is what stands behind its last <; names end at the first character that is no letter, digit or /.
# Every part is possessive and bounded by the next < or >, so that a page is read once however it is made.
_RESTARTED = r"<[^<>]*+(?=<)"
_SCRIPT = r"<(?:script|style)(?:[^A-Za-z0-9/<>][^<>]*+)?+>"
_SCRIPT_END = r"</(?:script|style)(?:[^A-Za-z0-9/<>][^<>]*+)?+>"
_TAG = r"<[^<>]*+(?:>|\z)"


def _body(html: Column) -> Column:
    """What stands between the first body tag's > and the next end tag, or the page's end; all of a page without one."""
    start = F.regexp_instr(html, F.lit("(?i)<body"))
    close = F.position(F.lit(">"), html, start)
    inside = F.substr(html, F.when(close > 0, close + 1).otherwise(start))
    end = F.regexp_instr(inside, F.lit("(?i)</body>"))
    return F.when(start > 0, F.when(end > 0, F.left(inside, end - 1)).otherwise(inside)).otherwise(html)


def body_text_bytes(html: Column) -> Column:
    """UTF-8 bytes of the body's visible text: no scripts, styles or tags, white space runs as one, none at the ends."""
    tags = F.regexp_replace(_body(html), _RESTARTED, "")
    plain = F.regexp_replace(F.regexp_replace(tags, rf"(?is){_SCRIPT}.*?(?:{_SCRIPT_END}|\z)", ""), _TAG, "")
    return F.octet_length(F.regexp_replace(F.regexp_replace(plain, WS + "+", " "), r"\A | \z", ""))


def has_thin_body(html: Column) -> Column:
    return body_text_bytes(html) < BODY_BYTES


def is_js_dependent(html: Column) -> Column:
    """A thin body in a page with a script or the root element of a single-page application."""
    marks = F.contains(html, F.lit("<script"))
    for root in SPA_ROOTS:
        marks = marks | F.contains(html, F.lit(root))
    return has_thin_body(html) & marks


def visible_text_len(html: Column, limit: int | None = None) -> Column:
    """Characters outside tags that are not white space, at most `limit`."""
    n = F.char_length(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*(?:>|\z)", ""), WS + "+", ""))
    return n if limit is None else F.least(n, F.lit(limit))


def extract_title(html: Column) -> Column:
    """The trimmed text of the first title element; null if there is none or it is empty. Entities stay."""
    start = F.regexp_instr(html, F.lit("(?i)<title"))
    close = F.position(F.lit(">"), html, start)
    inside = F.substr(html, close + 1)
    end = F.regexp_instr(inside, F.lit("(?i)</title>"))
    return F.when((start > 0) & (close > 0) & (end > 0), F.nullif(trim(F.left(inside, end - 1)), F.lit("")))


def is_thin_extract(article: Column) -> Column:
    return article["used_raw_fallback"] | (visible_text_len(article["content_html"], EXTRACT_CHARS) < EXTRACT_CHARS)


ARTICLE = "title string, byline string, published_time string, content_html string, used_raw_fallback boolean"
#: A page as it is fetched: its article and the Markdown of it.
PAGE = f"{ARTICLE}, markdown string"


def _title(html: str) -> str | None:
    """Between the first title tag's > and the next end tag."""
    start = re.search("<title", html, re.I)
    close = html.find(">", start.end()) if start else -1
    end = re.compile("</title>", re.I).search(html, close + 1) if close >= 0 else None
    return html[close + 1 : end.start()].strip() or None if end else None


def article_of(html: str) -> tuple:
    """(title, byline, published_time, content_html, used_raw_fallback): the main article, or the whole page where it is not readable."""
    found = readable.article_of(html)
    return (_title(html), None, None, html, True) if found is None else (_title(html), found.byline, found.published, found.html(), False)


def page_of(html: str, raw: bool = False) -> tuple:
    """article_of() and its Markdown, the page parsed once; with `raw` the whole page."""
    root = dom.parse(html)
    found = None if raw else readable.article_of(html, root)
    if found is None:
        return _title(html), None, None, html, not raw, markdown.render([root])
    return _title(html), found.byline, found.published, found.html(), False, markdown.render(found.parts)


def markdown_of(html: str) -> str:
    return markdown.render([dom.parse(html)])


@text_udf(ARTICLE)
def _article(html: str | None) -> tuple:
    return article_of(html) if html is not None else (None, None, None, None, True)


def extract_article(html: Column) -> Column:
    return _article(html)


@text_udf(PAGE)
def _page(html: str | None, raw: bool) -> tuple:
    return page_of(html, bool(raw)) if html is not None else (None, None, None, None, True, None)


def read_page(html: Column, raw: Column) -> Column:
    """The article of a page, or with `raw` the whole page, and its Markdown in one pass."""
    return _page(html, raw)


def extract_raw(html: Column, fallback: bool = False) -> Column:
    """The whole page as an article."""
    null = F.lit(None).cast("string")
    return F.struct(extract_title(html).alias("title"), null.alias("byline"), null.alias("published_time"), html.alias("content_html"), F.lit(fallback).alias("used_raw_fallback"))


@text_udf("string")
def _markdown(html: str | None) -> str | None:
    return None if html is None else markdown_of(html)


def html_to_markdown(html: Column) -> Column:
    return _markdown(html)


def format_with_frontmatter(article: Column, text: Column) -> Column:
    """Markdown behind a YAML block that is always there; its lines only where set."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'{name}: "'), escape_yaml(value), F.lit('"\n'))).otherwise("")
    return F.concat(F.lit("---\n"), line("title", article["title"]), line("author", article["byline"]), line("date", article["published_time"]), F.lit("---\n\n"), text)


def format_fetch_output(text: Column, used_raw_fallback: Column) -> Column:
    """What the fetch command prints: headings two levels down, a note for raw pages, at most 100,000 bytes."""
    shifted = shift_headings(text, 2)
    return truncate_with_note(F.when(used_raw_fallback, F.concat(F.lit(RAW_FALLBACK_NOTE), shifted)).otherwise(shifted), OUTPUT_BYTES)


def parse_renderer_output(stdout: Column) -> Column:
    """The HTML in a headless renderer's output: a JSON string after the result mark, or raw HTML; else null."""
    mark = "### Result\n"
    after = F.when(F.contains(stdout, F.lit(mark)), F.array_join(F.slice(F.split(stdout, mark, -1), 2, 2**31 - 1), mark)).otherwise(stdout)
    text = trim(after)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), F.substring_index(text, "\n###", 1), F.lit("}")), "$.v")
    raw = F.when(F.contains(text, F.lit("<html")) | F.contains(text, F.lit("<body")), text)
    return F.coalesce(F.when(F.startswith(text, F.lit('"')), quoted), raw)
