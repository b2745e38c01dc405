"""Search responses to results, sources and reports; rows are keyed by request_id, so that any number of requests
run in one job. Order comes from index columns, never from the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import errors
from webloom.functions.html import RAW_FALLBACK_NOTE
from webloom.functions.text import apply_language, escape_md_link, expand_bilingual, sanitize_heading, shift_headings, truncate_with_note
from webloom.operators.exchanges import latest
from webloom.schemas import SEARCH_RESPONSE

# Limits and wording of reports.
DEPTH = 3
PAGE_BYTES = 3000
# Fixed value: terms of all queries, with repeats, that local search hands to every task.
ASKED_TERMS = 1_000_000
NO_ANSWER = "(No answer returned — the query may have been filtered by safety settings.)"


def expand_queries(requests: DataFrame) -> DataFrame:
    """(request_id, query_idx, search_query): an automatic language asks a Japanese query in ASCII terms too."""
    asked = F.when(F.coalesce("lang", F.lit("auto")) == "auto", expand_bilingual(F.col("query"))).otherwise(F.array(apply_language(F.col("query"), F.col("lang"))))
    return requests.select("request_id", F.posexplode(asked).alias("query_idx", "search_query"))


def grounded_result(body: Column) -> Column:
    """struct(answer, sources, corrupt) of a response's first candidate and its first part. Sources without a
    web record or address go, a missing title is empty, repeated sources stay."""
    r = F.from_json(body, SEARCH_RESPONSE, {"columnNameOfCorruptRecord": "_corrupt"})
    first = F.get(r["candidates"], F.lit(0))
    text = F.get(first["content"]["parts"], F.lit(0))["text"]
    chunks = F.coalesce(first["groundingMetadata"]["groundingChunks"], F.array().cast("array<struct<web:struct<uri:string,title:string>>>"))
    webs = F.filter(F.transform(chunks, lambda c: c["web"]), lambda w: w.isNotNull() & (F.coalesce(w["uri"], F.lit("")) != ""))
    sources = F.transform(webs, lambda w: F.struct(w["uri"].alias("url"), F.coalesce(w["title"], F.lit("")).alias("title")))
    return F.struct(F.nullif(text, F.lit("")).alias("answer"), sources.alias("sources"), (r.isNull() | r["_corrupt"].isNotNull()).alias("corrupt"))


def search_results(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """`queries` joined with recorded responses (search_query, status, body): adds answer, sources and error. A query
    without a response failed on the network."""
    joined = queries.join(latest(responses, "search_query"), "search_query", "left").withColumn("_r", grounded_result(F.col("body")))
    kind = F.when(F.col("status").isNull(), "Network").otherwise(F.coalesce(errors.search_status(F.col("status"), F.col("body")), F.when(F.col("_r.corrupt"), "Network")))
    own, code = F.get_json_object("body", "$.error").isNotNull(), F.get_json_object("body", "$.error.code").try_cast("int")
    said = F.coalesce(F.get_json_object("body", "$.error.message"), F.lit("Unknown error"))
    structured = F.when(code.isNull(), F.concat(F.lit("(0): Unknown error (no status code): "), said)).otherwise(F.concat(F.lit("("), code.cast("string"), F.lit("): "), said))
    plain = F.concat(F.lit("("), F.col("status").cast("string"), F.lit("): HTTP "), errors.status_line(F.col("status")), F.lit(": "), F.left(F.coalesce("body", F.lit("")), F.lit(200)))
    detail = F.when(kind == "Api", F.when(own, structured).otherwise(plain)).when(kind == "QuotaExhausted", said).when(kind == "Network", F.when(F.col("status").isNull(), "no response").otherwise("error decoding response body"))
    empty = F.array().cast("array<struct<url:string,title:string>>")
    return joined.select(*queries.columns, F.when(kind.isNull(), F.col("_r.answer")).alias("answer"), F.when(kind.isNull(), F.col("_r.sources")).otherwise(empty).alias("sources"), errors.error("search", kind, detail).alias("error"))


def partition_searches(results: DataFrame) -> DataFrame:
    """(request_id, results, error): successes in query order; an error, the first, only if no search succeeded."""
    ok = F.col("error").isNull()
    row = F.struct("query_idx", "answer", "sources")
    grouped = results.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(ok, row))).alias("results"),  # a request has one or two queries
        F.min_by("error", F.when(~ok, F.col("query_idx"))).alias("_first"),
    )
    return grouped.select("request_id", "results", F.when(F.size("results") == 0, F.col("_first")).alias("error"))


def unique_sources(results: DataFrame) -> DataFrame:
    """(request_id, rank, url, title): addresses once, with the title and in the order of first sight; empty ones go."""
    flat = results.select("request_id", "query_idx", F.posexplode("sources").alias("source_idx", "s")).select("request_id", "query_idx", "source_idx", "s.url", "s.title")
    first = Window.partitionBy("request_id", "url").orderBy("query_idx", "source_idx")
    seen = flat.filter(F.coalesce("url", F.lit("")) != "").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = Window.partitionBy("request_id").orderBy("query_idx", "source_idx")
    return seen.select("request_id", F.row_number().over(order).cast("long").alias("rank"), "url", "title")


def top_sources(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """The sources to fetch: rank up to the request's depth; failures are not filled up from below."""
    return sources.join(requests.select("request_id", F.coalesce("depth", F.lit(DEPTH)).alias("_depth")), "request_id").filter(F.col("rank") <= F.col("_depth")).drop("_depth")


def partition_fetches(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """wanted (request_id, rank, url) with markdown, used_raw_fallback, final_url and the reason of failures. Fetches with a
    request_id are that request's own, others anyone's."""
    joined = wanted.join(fetched, ["request_id", "url"] if "request_id" in fetched.columns else "url", "left")
    missing = F.col("final_url").isNull() & F.col("error").isNull()
    return joined.select("request_id", "rank", "url", "final_url", "markdown", "used_raw_fallback", F.when(missing, F.lit("fetch failed: no response")).otherwise(F.col("error.message")).alias("reason"))


def _joined(rows: Column, line) -> Column:
    """Text of an array of structs, sorted by its first field."""
    return F.array_join(F.transform(F.array_sort(rows), line), "")


def format_search_results(results: Column) -> Column:
    many = F.size(results) > 1
    return F.array_join(
        F.transform(
            results,
            lambda r, i: F.concat(F.when(many, F.concat(F.lit("## Search Result "), (i + 1).cast("string"), F.lit("\n\n"))).otherwise(""), F.coalesce(r["answer"], F.lit(NO_ANSWER + "\n")), F.lit("\n\n")),
        ),
        "",
    )


def format_sources(sources: Column) -> Column:
    """List lines of an array of structs whose fields include url and title, in order."""
    return _joined(sources, lambda s: F.concat(F.lit("- ["), escape_md_link(s["title"]), F.lit("]("), escape_md_link(s["url"]), F.lit(")\n")))


def format_page(url: Column, markdown: Column, used_raw_fallback: Column) -> Column:
    """A fetched page's section: headings three levels down, then at most 3,000 bytes."""
    note = F.when(used_raw_fallback, RAW_FALLBACK_NOTE).otherwise("")
    return F.concat(F.lit("### "), escape_md_link(url), F.lit("\n\n"), note, truncate_with_note(shift_headings(markdown, 3), PAGE_BYTES), F.lit("\n\n"))


def format_search(answer: Column, sources: Column) -> Column:
    """What the search command prints."""
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- ["), escape_md_link(s["title"]), F.lit("]("), escape_md_link(s["url"]), F.lit(")\n"))), "")
    return F.concat(F.coalesce(answer, F.lit(NO_ANSWER)), F.when(F.size(sources) > 0, F.concat(F.lit("\n\n---\n**Sources:**\n"), listed)).otherwise(""))


def format_reports(requests: DataFrame, results: DataFrame, fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, report, error) from requests (request_id, query), partitioned searches, partitioned fetches and
    unique sources. Sections without rows are left out; pages stand in the order of their sources."""
    ok = F.col("reason").isNull()
    page = F.struct("rank", format_page(F.col("final_url"), F.col("markdown"), F.col("used_raw_fallback")).alias("text"))
    failed = F.struct("rank", F.concat(F.lit("- "), escape_md_link(F.col("url")), F.lit(" ("), F.col("reason"), F.lit(")\n")).alias("text"))
    # at most `depth` pages and the sources of two searches: small groups
    by_fetch = fetches.groupBy("request_id").agg(F.collect_list(F.when(ok, page)).alias("pages"), F.collect_list(F.when(~ok, failed)).alias("failed"))
    by_source = sources.groupBy("request_id").agg(F.collect_list(F.struct("rank", "url", "title")).alias("all_sources"))
    all_ = requests.select("request_id", "query").join(results, "request_id", "left").join(by_fetch, "request_id", "left").join(by_source, "request_id", "left")

    def section(rows: str, head: str, body: Column, tail: str = "") -> Column:
        return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat(F.lit(head), body, F.lit(tail))).otherwise("")

    report = F.concat(
        F.lit("# Research: "),
        sanitize_heading(F.col("query")),
        F.lit("\n\n"),
        format_search_results(F.col("results")),
        section("pages", "---\n\n## Fetched Pages\n\n", _joined(F.col("pages"), lambda x: x["text"])),
        section("failed", "## Failed URLs\n\n", _joined(F.col("failed"), lambda x: x["text"]), "\n"),
        section("all_sources", "## Sources\n\n", format_sources(F.col("all_sources"))),
    )
    return all_.select("request_id", F.when(F.col("error").isNull(), report).alias("report"), "error")


def local_search(queries: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """A stand-in for the hosted search where there is no network, not a copy of its ranking: documents by the number
    of the query's terms they hold. Gives (search_query, status, body) like recorded responses.

    Terms are asked the rarest first. The k-th best count by the rarer half bounds the k-th best of all from below; what
    reaches it, L of T terms, holds one of the T - L + 1 rarest. Only such pairs of query and document are made and counted
    in full, so a word that is everywhere makes no rows of its own. Texts are read once, to the asked terms that each holds;
    what follows keeps these rows in place, unless the queries have more terms than are handed to every task."""
    split = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+"))
    terms = queries.select("search_query", F.explode(split("search_query")).alias("term")).filter("term != ''").distinct()
    few = terms.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
    handed = F.broadcast if few else lambda df: df
    vocabulary = terms.select("term").distinct()
    # the filter is what the last join would add to one reading alone, so that all of them are the same
    words = documents.filter("doc_id IS NOT NULL").select("doc_id", F.explode(split("text")).alias("term")).join(handed(vocabulary), "term", "left_semi")
    held = words.groupBy("doc_id").agg(F.collect_set("term").alias("held"))
    postings = held.select("doc_id", F.explode("held").alias("term"))
    often = postings.groupBy("term").agg(F.count("*").alias("df"))
    by_query = Window.partitionBy("search_query")
    asked = terms.join(often, "term").withColumn("r", F.row_number().over(by_query.orderBy("df", "term"))).withColumn("t", F.count("*").over(by_query))
    half = postings.join(handed(asked.filter(F.col("r") * 2 <= F.col("t") + 1).select("term", "search_query")), "term").groupBy("doc_id", "search_query").agg(F.count("*").alias("n"))
    kth = half.withColumn("k", F.row_number().over(by_query.orderBy(F.desc("n")))).filter(F.col("k") == k).select("search_query", F.col("n").alias("least"))
    first = asked.join(kth, "search_query", "left").filter(F.col("r") <= F.col("t") - F.coalesce("least", F.lit(1)) + 1)
    pairs = postings.join(handed(first.select("term", "search_query")), "term").select("doc_id", "search_query").distinct()
    wanted = asked.groupBy("search_query").agg(F.collect_set("term").alias("wanted"))  # a query's own terms
    scored = pairs.join(held, "doc_id").join(handed(wanted), "search_query").select("search_query", "doc_id", F.size(F.array_intersect("held", "wanted")).alias("n"))
    best = scored.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("n"), "doc_id"))).filter(F.col("r") <= k)
    chunk = F.struct(F.struct(F.concat(F.lit("doc://"), F.col("doc_id")).alias("uri"), F.concat(F.lit("document "), F.col("doc_id")).alias("title")).alias("web"))
    grouped = best.groupBy("search_query").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    answer = F.struct(F.array(F.struct(F.concat(F.size("chunks").cast("string"), F.lit(" documents")).alias("text"))).alias("parts"))
    body = F.to_json(F.struct(F.array(F.struct(answer.alias("content"), F.struct(F.col("chunks").alias("groundingChunks")).alias("groundingMetadata"))).alias("candidates")))
    return grouped.select("search_query", F.lit(200).alias("status"), body.alias("body"))
