"""Command line: one request, its text on standard output, errors on standard error with an exit code."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom.errors import PipelineError
from webloom.functions.urls import parse_permalink
from webloom.operators.fetch import to_render
from webloom.plans import commands
from webloom.sources import credentials, live, recorded, render

log = logging.getLogger("webloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom")
    p.add_argument("--recorded", help="folder of recorded exchanges instead of the network")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-l", "--lang", choices=("auto", "ja", "en"), default="auto")
    f = sub.add_parser("fetch")
    f.add_argument("url")
    f.add_argument("--js", action="store_true")
    f.add_argument("--raw", action="store_true")
    r = sub.add_parser("research")
    r.add_argument("query")
    r.add_argument("-d", "--depth", type=int, choices=range(1, 11), default=3)
    r.add_argument("-l", "--lang", choices=("auto", "ja", "en"), default="auto")
    t = sub.add_parser("repo-tree")
    t.add_argument("repository")
    t.add_argument("--ref")
    t.add_argument("-p", "--path")
    t.add_argument("--pattern")
    d = sub.add_parser("repo-read")
    d.add_argument("repository")
    d.add_argument("path")
    d.add_argument("--ref")
    d.add_argument("-l", "--lines")
    o = sub.add_parser("repo-overview")
    o.add_argument("repository")
    return p


def plan(spark: SparkSession, a: argparse.Namespace):
    """The command's DataFrame. Live sources are asked only for what the command needs."""
    table = lambda name: recorded.read(spark, a.recorded, name)
    if a.command in ("search", "research"):
        asked = spark.createDataFrame([(1, a.query, getattr(a, "depth", None), a.lang)], "request_id long, query string, depth int, lang string")
        if a.recorded:
            answers = table("search")
        else:
            from webloom.functions.text import apply_language
            from webloom.operators.research import expand_queries

            key, model = credentials.search_key()
            queries = expand_queries(asked) if a.command == "research" else asked.select(apply_language(asked.query, asked.lang).alias("search_query"))
            answers = live.search_api(queries, key, model).persist()
        if a.command == "search":
            return commands.search(asked, answers)
        if a.recorded:
            return commands.research(asked, answers, table("responses"))
        from webloom.operators.research import expand_queries, search_results, top_sources, unique_sources

        urls = top_sources(unique_sources(search_results(expand_queries(asked), answers)), asked)
        # one request: a few pages in flight, each within its own time
        return commands.research(asked, answers, live.pages(urls, partitions=1, get=partial(live.get_page, total_s=live.RESEARCH_PAGE_S)).persist())
    if a.command == "fetch":
        asked = spark.createDataFrame([(1, a.url, a.js, a.raw)], "request_id long, url string, js boolean, raw boolean")
        if a.recorded:
            return commands.fetch(asked, table("responses"), chat=(table("messages"), table("users"), table("channels")))
        links = asked.select(F.col("request_id").alias("key"), parse_permalink(F.col("url")).alias("link")).filter("link IS NOT NULL")
        if links.limit(1).count():
            token = credentials.chat_token()
            none = spark.createDataFrame([], "path string, body string, api_error string")
            said = live.complete(lambda known: live.chat_calls(links, known), lambda new: live.chat_api(new, token), none)
            return commands.fetch(asked, recorded.empty(spark, "responses"), chat=live.chat_tables(said))
        pages = live.pages(asked).persist()
        return commands.fetch(asked, pages, rendered=render.rendered(to_render(asked, pages), 1).persist())
    if a.command == "repo-tree":
        asked = spark.createDataFrame([(1, a.repository, a.ref)], "request_id long, repository string, ref string")
        return commands.repo_tree(asked, _repo(spark, a, asked), a.path, a.pattern)
    if a.command == "repo-read":
        asked = spark.createDataFrame([(1, a.repository, a.path, a.ref, a.lines)], "request_id long, repository string, file string, ref string, lines string")
        return commands.repo_read(asked, _repo(spark, a, asked))
    asked = spark.createDataFrame([(1, a.repository)], "request_id long, repository string")
    return commands.repo_overview(asked, _repo(spark, a, asked))


def _repo(spark: SparkSession, a: argparse.Namespace, asked):
    """Recorded repository exchanges, or those that the request needs from the API."""
    if a.recorded:
        return recorded.read(spark, a.recorded, "api")
    token = credentials.repo_token()
    return live.complete(lambda known: commands.repo_paths(asked, known), lambda new: live.repo_api(new, token), recorded.empty(spark, "api"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(stream=sys.stderr, level=logging.WARNING)
    log.setLevel(os.environ.get("WEBLOOM_LOG", "INFO").upper())
    args = parser().parse_args(argv)
    log.info("%s%s", args.command, " from recorded exchanges" if args.recorded else "")
    session = spark or SparkSession.builder.appName("webloom").getOrCreate()
    try:
        row = plan(session, args).first()  # one request, one row
        if row["error"] is not None:
            raise PipelineError(row["error"]["message"], row["error"]["exit_code"])
        text = row["report"] if "report" in row.asDict() else row["output"]
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
        return 0
    except PipelineError as e:
        log.debug("failed with exit code %d", e.exit_code)
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
