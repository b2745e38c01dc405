"""The six commands and the chat fetch as DataFrame plans: tables of requests in, one text per request out.

Sources are DataFrames of recorded exchanges (see webloom.schemas) or what webloom.sources.live fetches;
every failure is a value in `error`, never an exception, so one bad request does not end a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import errors, schemas
from webloom.functions.html import format_fetch_output
from webloom.functions.text import apply_language, parse_line_range
from webloom.functions.urls import glob_regex, parse_permalink, parse_repo, validate_path, validate_ref
from webloom.operators import fetch as fetch_ops
from webloom.operators import repo as repo_ops
from webloom.operators import research as research_ops
from webloom.operators import threads as thread_ops


def search(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (request_id, query, lang) → request_id, output, error. One query each, in the language asked for."""
    asked = requests.select("request_id", apply_language(F.col("query"), F.coalesce("lang", F.lit("auto"))).alias("search_query"))
    found = research_ops.search_results(asked, responses)
    return found.select("request_id", F.when(F.col("error").isNull(), research_ops.format_search(F.col("answer"), F.col("sources"))).alias("output"), "error")


def fetch(requests: DataFrame, responses: DataFrame, resolved: DataFrame | None = None, rendered: DataFrame | None = None, chat: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """requests (request_id, url, js, raw) → request_id, output, error. Permanent links of chat messages go to the chat
    tables (messages, users, channels); anything else is a page."""
    routed = requests.withColumn("_link", parse_permalink(F.col("url")))
    pages = fetch_ops.fetch_pages(routed.filter("_link IS NULL").drop("_link"), responses, resolved, rendered)
    out = pages.select("request_id", format_fetch_output(F.col("markdown"), F.col("used_raw_fallback")).alias("output"), "error")
    links = routed.filter("_link IS NOT NULL").select(F.col("request_id").alias("key"), F.col("_link").alias("link"))
    if chat is None:
        missing = errors.error("chat", F.lit("TokenNotSet"), F.lit(None).cast("string"))
        return out.unionByName(links.select(F.col("key").alias("request_id"), F.lit(None).cast("string").alias("output"), missing.alias("error")))
    return out.unionByName(thread_ops.fetch_threads(links, *chat).select(F.col("key").alias("request_id"), "output", "error"))


def research(requests: DataFrame, responses: DataFrame, pages: DataFrame, resolved: DataFrame | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """requests (request_id, query, depth, lang) → request_id, report, error: search, sources once each, the first
    `depth` of them fetched (each address once for all requests), one report."""
    results = research_ops.search_results(research_ops.expand_queries(requests), responses)
    parts = research_ops.partition_searches(results)
    sources = research_ops.unique_sources(results)
    wanted = research_ops.top_sources(sources, requests)
    urls = wanted.select("url").distinct().select("url", F.lit(False).alias("js"), F.lit(False).alias("raw"))
    fetched = fetch_ops.fetch_pages(urls, pages, resolved, rendered).select("url", "final_url", "markdown", "used_raw_fallback", "error")
    return research_ops.format_reports(requests, parts, research_ops.partition_fetches(wanted, fetched), sources)


def _repos(requests: DataFrame) -> DataFrame:
    """requests with owner, repo and the kind of what is wrong with them so far."""
    parsed = requests.withColumn("_r", parse_repo(F.col("repository")))
    return parsed.select("*", F.col("_r.owner").alias("owner"), F.col("_r.repo").alias("repo"), F.when(F.col("_r").isNull(), "InvalidRepo").alias("_kind"), F.col("repository").alias("_detail")).drop("_r")


def _check(df: DataFrame, column: str, valid, kind: str) -> DataFrame:
    bad = F.col("_kind").isNull() & F.col(column).isNotNull() & ~valid(F.col(column))
    return df.withColumn("_detail", F.when(bad, F.col(column)).otherwise(F.col("_detail"))).withColumn("_kind", F.when(bad, kind).otherwise(F.col("_kind")))


def repo_tree(requests: DataFrame, responses: DataFrame, path: str | None = None, pattern: str | None = None, largest: str = "MB") -> DataFrame:
    """requests (request_id, repository, ref) → request_id, output, error: the files of each repository at its ref (null:
    the default branch) below a path prefix and by a glob on their names, sizes in units up to `largest`."""
    asked = _check(_repos(requests), "ref", validate_ref, "InvalidRef")
    if path is not None:
        asked = _check(asked.withColumn("_path", F.lit(path)), "_path", validate_path, "InvalidPath").drop("_path")
    if pattern is not None:
        try:
            glob_regex(pattern)
        except ValueError as e:
            asked = asked.withColumn("_detail", F.when(F.col("_kind").isNull(), str(e)).otherwise(F.col("_detail"))).withColumn("_kind", F.coalesce("_kind", F.lit("InvalidPattern")))
            pattern = None
    info = repo_ops.api_rows(asked.withColumn("path", F.when(F.col("ref").isNull(), repo_ops.repo_path())), responses, schemas.REPO_INFO, "info").drop("path")
    at = info.withColumn("_ref", F.coalesce("ref", "info.default_branch"))
    tree = repo_ops.api_rows(at.withColumn("path", repo_ops.tree_path(F.col("_ref"))), responses, schemas.TREE, "tree").drop("path")
    own = errors.error("repo", F.col("_kind"), F.col("_detail"))
    failed = F.coalesce(own, F.when(F.col("ref").isNull(), F.col("info_error")), F.col("tree_error"))
    done = tree.withColumn("error", failed)
    entries = done.filter("error IS NULL").select(F.col("request_id").alias("key"), F.posexplode("tree.tree").alias("idx", "e")).select("key", "idx", "e.*")
    heads = done.select(F.col("request_id").alias("key"), "owner", "repo", F.col("_ref").alias("ref"), F.coalesce("tree.truncated", F.lit(False)).alias("truncated"), "error")
    text = repo_ops.format_tree(repo_ops.filter_tree(entries, path, pattern), heads, largest)
    return text.select(F.col("key").alias("request_id"), F.when(F.col("error").isNull(), F.col("output")).alias("output"), "error")


def repo_read(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (request_id, repository, file, ref, lines) → request_id, output, error: a file's numbered lines."""
    asked = _check(_check(_repos(requests), "file", validate_path, "InvalidPath"), "ref", validate_ref, "InvalidRef")
    contents = repo_ops.api_rows(asked.withColumn("path", repo_ops.contents_path(F.col("file"), F.col("ref"))), responses, schemas.CONTENTS, "contents").drop("path")
    lacks = F.col("contents").isNotNull() & F.col("contents.content").isNull()
    blob = repo_ops.api_rows(contents.withColumn("path", F.when(lacks, repo_ops.repo_path("/git/blobs/", F.col("contents.sha")))), responses, schemas.BLOB, "blob").drop("path")
    read = blob.withColumn("_f", repo_ops.file_content(F.col("contents.content"), F.col("blob.content")))
    span = read.withColumn("_s", F.when(F.col("lines").isNull(), F.struct(F.lit(1).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))).otherwise(parse_line_range(F.col("lines"))))
    prior = F.coalesce(errors.error("repo", F.col("_kind"), F.col("_detail")), F.col("contents_error"), F.when(lacks, F.col("blob_error")))
    decode = errors.error("repo", F.when(F.col("_f.error").isNotNull(), F.lit("Decode")), F.regexp_replace("_f.error", "^Content decode error: ", ""))
    ranged = errors.error("repo", F.when(F.col("_s").isNull(), F.lit("InvalidLineRange")), F.col("lines"))
    done = span.withColumn("error", F.coalesce(prior, decode, ranged))
    text = repo_ops.format_file(F.col("file"), F.col("_f.text"), F.col("_s.start"), F.col("_s.end"))
    return done.select("request_id", F.when(F.col("error").isNull(), text).alias("output"), "error")


def repo_overview(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (request_id, repository) → request_id, output, error."""
    asked = _repos(requests).withColumn("key", F.col("request_id"))
    done = repo_ops.overview(asked, responses)
    own = errors.error("repo", F.col("_kind"), F.col("_detail"))
    return done.select("request_id", F.when(own.isNull(), F.col("output")).alias("output"), F.coalesce(own, F.col("error")).alias("error"))


def repo_paths(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The API paths that a live source must ask for, as far as `responses` tells: asked again with what came back, it
    names the default branch's tree and the blobs of files without content. requests has the columns of repo_tree,
    repo_read (with `file`) or repo_overview (neither `ref` nor `file`)."""
    asked = _repos(requests).filter("_kind IS NULL")
    if "file" in requests.columns:
        contents = asked.withColumn("path", repo_ops.contents_path(F.col("file"), F.col("ref")))
        known = repo_ops.api_rows(contents, responses, schemas.CONTENTS, "contents")
        blob = F.when(F.col("contents").isNotNull() & F.col("contents.content").isNull(), repo_ops.repo_path("/git/blobs/", F.col("contents.sha")))
        return known.select(F.explode(F.array("path", blob)).alias("path")).filter("path IS NOT NULL").distinct()
    if "ref" in requests.columns:
        known = repo_ops.api_rows(asked.withColumn("path", F.when(F.col("ref").isNull(), repo_ops.repo_path())), responses, schemas.REPO_INFO, "info")
        tree = repo_ops.tree_path(F.coalesce("ref", "info.default_branch"))
        return known.select(F.explode(F.array("path", tree)).alias("path")).filter("path IS NOT NULL").distinct()
    return asked.select(F.explode(F.array(*[repo_ops.repo_path(tail) for _, _, tail in repo_ops.OVERVIEW_PARTS])).alias("path")).distinct()
