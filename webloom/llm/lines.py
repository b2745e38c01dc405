"""Line dedup by site-relative frequency: lines that too many pages of one host share are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import columns_of, dropped, fresh, quoted, stored, text_or_empty

#: Rows of the flagged-line table up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_LINES = 200_000


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(quoted(host_col)).cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def boilerplate_lines(docs: DataFrame, ratio: float = 0.1, min_pages: int = 2, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines in more than `ratio` of a host's pages and in at
    least `min_pages` of them (a line of one page only is shared by none); `line` is the line's MD5.

    A page counts once per line; empty lines are never counted. A null host is the host ''. Counting
    is pre-aggregated by task, so neither a hot host nor a hot line meets in one task."""
    pages = docs.select(_host(host_col).alias("host"), F.col(quoted(text_col)).alias("text"))
    lines = pages.select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x != ""))).alias("line"))
    counted = lines.select("host", F.md5("line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return counted.join(totals, "host").filter(F.col("n_pages") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 2, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """`docs` with the flagged lines taken out of `text_col` and, last, _n_lines and _n_dropped; where `docs` has a
    column of that name, ours has more underscores behind.

    Every row stays, in whatever number it is repeated; a null text stays null (0 lines) and a text of
    flagged lines only becomes empty. A host has at most (mean lines per page) / ratio flagged lines,
    so its flags fit one row. A page's lines meet them as hash sets."""
    n_lines, n_dropped, host, flagged, here, kept = fresh(docs.columns, "_n_lines", "_n_dropped", "_host", "_flagged", "_here", "_kept")
    found = stored(boilerplate_lines(docs, ratio, min_pages, host_col, text_col).select("host", "line"))
    by_host = stored(found.groupBy("host").agg(F.collect_set("line").alias(flagged)).withColumnRenamed("host", host))
    if found.count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    dropped(found)
    joined = docs.withColumn(host, _host(host_col)).join(by_host, host, "left")
    text = F.col(quoted(text_col))
    lines, there = _lines(text), text.isNotNull()
    common = F.when(F.col(flagged).isNotNull(), F.array_intersect(F.transform(lines, F.md5), F.col(flagged)))
    marked = joined.withColumn(here, common)
    left = F.when(F.size(here) > 0, F.filter(lines, lambda x: (x == "") | ~F.array_contains(F.col(here), F.md5(x)))).otherwise(lines)
    marked = marked.withColumn(kept, left)
    out = [F.when(there, F.array_join(F.col(kept), "\n")).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns]
    return marked.select(*out, F.when(there, F.size(lines)).otherwise(0).alias(n_lines), F.when(there, F.size(lines) - F.size(kept)).otherwise(0).alias(n_dropped))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
n AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
f AS (SELECT l.host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS c FROM l WHERE line <> '' GROUP BY host, line) l JOIN n USING (host)
      WHERE c >= 2 AND c > 0.1 * pages),
k AS (SELECT l.doc_id, l.line, l.pos, f.line IS NULL AS kept FROM l LEFT JOIN f ON l.host = f.host AND l.line = f.line),
g AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM g
"""
