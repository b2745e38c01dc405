"""Pages: guard, response, rendering, extraction and Markdown as one chain of joins and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import errors
from webloom.functions import html as H
from webloom.functions.codec import accepts_content_type, decode_body, extract_charset, mime_type
from webloom.functions.urls import ssrf_check, url_guard
from webloom.operators.exchanges import latest

# Fixed value: bytes of a page that are read at most.
MAX_RESPONSE_BYTES = 10_000_000
UNREADABLE = "playwright-cli failed: could not parse playwright output"


def response_error(status: Column, content_type: Column, size: Column, failure: Column) -> Column:
    """Kind of a response's error: a failed exchange, a status outside 200-299, a type that is no text, too many bytes."""
    return (
        F.when(failure.isNotNull(), failure)
        .when(status.isNull(), "Http")
        .when(~status.between(200, 299), "Status")
        .when(~accepts_content_type(content_type), "UnsupportedContentType")
        .when(size > MAX_RESPONSE_BYTES, "TooLarge")
    )


def _guarded(df: DataFrame, url_col: str, resolved: DataFrame | None) -> DataFrame:
    return df.withColumn("guard_error", url_guard(F.col(url_col))) if resolved is None else ssrf_check(df, resolved, url_col)


def answered(asked: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """asked (url, final_url, status, content_type, body, failure, ...) with final_url, html, kind and detail instead of the
    exchange. Address and final address are guarded; without a table of resolved names only literals and names
    themselves are."""
    exchange = ("final_url", "status", "content_type", "body", "failure")
    keep = [c for c in asked.columns if c not in exchange]
    first = _guarded(asked.withColumn("final_url", F.coalesce("final_url", "url")), "url", resolved).withColumnRenamed("guard_error", "_guard1")
    twice = _guarded(first, "final_url", resolved)
    answer = response_error(F.col("status"), F.col("content_type"), F.octet_length("body"), F.col("failure"))
    kind = F.coalesce("_guard1", answer, "guard_error")
    detail = F.when(kind == "Status", F.col("status").cast("string")).when(kind == "UnsupportedContentType", mime_type(F.col("content_type"))).when(kind == "Http", F.lit("no response")).otherwise(F.col("url"))
    text = decode_body(F.col("body"), extract_charset(F.col("content_type")))
    return twice.select(*keep, "final_url", F.when(kind.isNull(), text).alias("html"), kind.alias("kind"), F.when(kind.isNotNull(), detail).alias("detail"))


def fetch_pages(requests: DataFrame, responses: DataFrame, resolved: DataFrame | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """requests (url, js, raw, ...) with final_url, markdown, used_raw_fallback and error, by their recorded responses (see
    fetch_responses), the latest ones where these are logs."""
    resolved = None if resolved is None else latest(resolved, "host", whole=True)
    rendered = None if rendered is None else latest(rendered, "url")
    return fetch_responses(requests.join(latest(responses, "url"), "url", "left"), resolved, rendered)


def to_render(requests: DataFrame, responses: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(url), once each: the final addresses of requests (url, js, raw) whose page must be rendered by a browser, since that is
    forced, the page needs scripts, or what could be extracted is thin."""
    resolved = None if resolved is None else latest(resolved, "host", whole=True)
    page = answered(requests.join(latest(responses, "url"), "url", "left"), resolved).filter("kind IS NULL")
    forced, raw = F.coalesce("js", F.lit(False)), F.coalesce("raw", F.lit(False))
    early = page.withColumn("_need", forced | H.is_js_dependent(F.col("html")))
    thin = ~raw & H.is_thin_extract(H.extract_article(F.when(~F.col("_need") & ~raw, F.col("html"))))
    return early.filter(F.col("_need") | thin).select(F.col("final_url").alias("url")).distinct()


def fetch_responses(asked: DataFrame, resolved: DataFrame | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """Requests with their exchange (url, js, raw, final_url, status, content_type, body, failure, ...) with final_url,
    markdown, used_raw_fallback and error instead.

    A page that asks for scripts, or whose extract is thin, is taken as rendered if `rendered` (url, stdout, failure)
    has it. If rendering was forced and failed, that is an error; otherwise the page stays as it was. With raw, nothing
    is extracted, yet pages that need scripts are still rendered. The chain has no state and works on a stream."""
    columns = [c for c in asked.columns if c not in ("final_url", "status", "content_type", "body", "failure")]
    page = answered(asked, resolved)
    if rendered is None:
        page = page.withColumn("_js_html", F.lit(None).cast("string")).withColumn("_js_failure", F.lit(None).cast("string"))
    else:
        ready = rendered.select(F.col("url").alias("final_url"), F.when(F.col("failure").isNull(), H.parse_renderer_output(F.col("stdout"))).alias("_js_html"), F.coalesce("failure", F.lit(UNREADABLE)).alias("_js_failure"))
        page = page.join(ready, "final_url", "left")
    forced, raw = F.coalesce("js", F.lit(False)), F.coalesce("raw", F.lit(False))
    need = forced | H.is_js_dependent(F.col("html"))
    failed = F.col("kind").isNull() & forced & F.col("_js_html").isNull()
    page = page.withColumn("_need", need).withColumn("_html", F.when(need, F.coalesce("_js_html", "html")).otherwise(F.col("html")))
    page = page.withColumn("detail", F.when(failed, F.coalesce("_js_failure", F.lit("no rendered page"))).otherwise(F.col("detail"))).withColumn("kind", F.when(failed, "Playwright").otherwise(F.col("kind")))
    page = page.withColumn("_a", H.read_page(F.when(F.col("kind").isNull(), F.col("_html")), raw))
    retry = ~raw & ~F.col("_need") & F.col("_js_html").isNotNull() & H.is_thin_extract(F.col("_a"))
    if rendered is not None:
        page = page.withColumn("_b", H.read_page(F.when(retry, F.col("_js_html")), F.lit(False))).withColumn("_a", F.when(retry, F.col("_b")).otherwise(F.col("_a")))
    markdown = H.format_with_frontmatter(F.col("_a"), F.col("_a.markdown"))
    ok = F.col("kind").isNull()
    return page.select(
        *columns,
        F.when(ok, F.col("final_url")).alias("final_url"),
        F.when(ok, markdown).alias("markdown"),
        F.when(ok, F.col("_a.used_raw_fallback")).alias("used_raw_fallback"),
        errors.error("fetch", F.col("kind"), F.col("detail")).alias("error"),
    )
