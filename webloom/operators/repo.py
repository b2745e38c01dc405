"""Repository records: API responses to rows, tree filters, files by line, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import errors, schemas
from webloom.functions import let
from webloom.functions.codec import decode_base64, error_message
from webloom.functions.text import escape_md_link, format_size, line_range, lines, shift_headings
from webloom.functions.urls import encode_path, glob_regex
from webloom.operators.exchanges import latest

# Rows of an overview and lines of its README.
OVERVIEW_ITEMS, OVERVIEW_RELEASES, README_LINES = 5, 3, 200
RECENT = f"state=open&sort=updated&direction=desc&per_page={OVERVIEW_ITEMS}"
#: An overview's parts: name, schema and path below the repository's.
OVERVIEW_PARTS = (
    ("info", schemas.REPO_INFO, ""),
    ("readme", schemas.CONTENTS, "/readme"),
    ("issues", schemas.ISSUES, f"/issues?{RECENT}"),
    ("pulls", schemas.PULLS, f"/pulls?{RECENT}"),
    ("releases", schemas.RELEASES, f"/releases?per_page={OVERVIEW_RELEASES}"),
)
# Wording of listings.
TRUNCATED_NOTE = " (tree truncated by GitHub — repository exceeds API limits)"
TABLE_HEAD = "| Attribute | Value |\n|-----------|-------|\n"


def api_rows(wanted: DataFrame, responses: DataFrame, schema: str, name: str) -> DataFrame:
    """wanted (path, ...) with the parsed body as `name` and `name`_error: recorded responses by path, the latest ones of a log.
    A body is parsed once, whatever is made of it. Rows that ask for nothing (path null) are spread over the join's tasks."""
    plain = [F.col(c) for c, t in wanted.dtypes if not t.startswith(("map", "struct", "array", "variant"))]
    asked = wanted.withColumn("_key", F.coalesce("path", F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string"))))  # no path begins so
    joined = asked.join(latest(responses, "path").withColumnRenamed("path", "_key"), "_key", "left").withColumn("_parsed", F.from_json("body", schema))
    kind = F.when(F.col("status").isNull(), "Network").otherwise(F.coalesce(errors.repo_status(F.col("status"), F.col("remaining")), F.when(F.col("_parsed").isNull(), "Network")))
    marked = joined.withColumn("_failed", kind)
    said = error_message(F.col("body"))
    detail = F.when(F.col("_failed") == "Api", F.concat(F.lit("("), F.col("status").cast("string"), F.lit("): "), said)).when(F.col("_failed") == "NotFound", F.col("path")).when(F.col("_failed") == "Network", F.lit("no usable response")).otherwise(said)
    return marked.select(*wanted.columns, F.when(F.col("_failed").isNull(), F.col("_parsed")).alias(name), errors.error("repo", F.col("_failed"), F.when(F.col("_failed").isNotNull(), detail)).alias(f"{name}_error"))


def repo_path(*tail: Column | str) -> Column:
    """The API path of a row's repository (owner, repo) and what follows."""
    return F.concat(F.lit("/repos/"), F.col("owner"), F.lit("/"), F.col("repo"), *[F.lit(x) if isinstance(x, str) else x for x in tail])


def tree_path(ref: Column) -> Column:
    return repo_path("/git/trees/", encode_path(ref), "?recursive=1")


def contents_path(file: Column, ref: Column) -> Column:
    return repo_path("/contents/", encode_path(file), F.when(ref.isNotNull(), F.concat(F.lit("?ref="), encode_path(ref))).otherwise(""))


def filter_tree(entries: DataFrame, prefix: str | None = None, pattern: str | None = None) -> DataFrame:
    """Files (path, type, ...) whose path begins with `prefix`, as text, and whose last segment matches the glob."""
    kept = entries.filter(F.col("type") == "blob")
    if prefix is not None:
        kept = kept.filter(F.startswith("path", F.lit(prefix)))
    if pattern is not None:
        try:
            regex = glob_regex(pattern)
        except ValueError as e:
            raise errors.PipelineError.user(f"Invalid glob pattern: {e}") from e
        kept = kept.filter(F.substring_index("path", "/", -1).rlike(regex))
    return kept


def tree_line(path: Column, size: Column, largest: str = "MB") -> Column:
    return F.concat(path, F.when(size.isNotNull(), F.concat(F.lit(" ("), format_size(size, largest), F.lit(")"))).otherwise(""), F.lit("\n"))


def format_tree(entries: DataFrame, trees: DataFrame, largest: str = "MB") -> DataFrame:
    """trees (key, owner, repo, ref, truncated) with output: header, number of files, and entries (key, idx, path, size)
    in their order, sizes in units up to `largest`. One listing is one text, as long as its repository has files."""
    listed = entries.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", tree_line(F.col("path"), F.col("size"), largest).alias("t")))), lambda x: x["t"]), "").alias("body"))
    head = F.concat("owner", F.lit("/"), "repo", F.lit(" (ref: "), "ref", F.lit(")\nfiles: "), F.coalesce("n", F.lit(0)).cast("string"), F.when(F.col("truncated"), TRUNCATED_NOTE).otherwise(""), F.lit("\n\n"))
    return trees.join(listed, "key", "left").select(*trees.columns, F.coalesce("n", F.lit(0)).alias("files"), F.concat(head, F.coalesce("body", F.lit(""))).alias("output"))


def file_content(contents: Column, blob: Column) -> Column:
    """struct(text, error) of a file: its own content, or its blob's where it is null; empty content is content."""
    return decode_base64(F.coalesce(contents, blob))


def format_file(path: Column, text: Column, start: Column, end: Column) -> Column:
    return let(lines(text), lambda all_: F.concat(path, F.lit(" ("), F.size(all_).cast("string"), F.lit(" lines)\n\n"), line_range(all_, start, end)))


def metadata_table(r: Column) -> Column:
    row = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"| {name} | "), value.cast("string"), F.lit(" |\n"))).otherwise("")
    topics = F.when(F.coalesce(F.size(r["topics"]), F.lit(0)) > 0, F.array_join(r["topics"], ", "))
    rows = [row("Language", r["language"]), row("Stars", r["stargazers_count"]), row("Forks", r["forks_count"]), row("Open Issues", r["open_issues_count"]), row("License", F.coalesce(r["license"]["spdx_id"], r["license"]["name"])), row("Default Branch", r["default_branch"]), row("Topics", topics), row("URL", r["html_url"])]
    return F.concat(F.lit(TABLE_HEAD), *rows, F.lit("\n"))


def readme_section(readme: Column) -> Column:
    all_ = lines(readme)
    n = F.size(all_)
    short = shift_headings(readme, 2)
    long = F.concat(shift_headings(F.array_join(F.slice(all_, 1, README_LINES), "\n"), 2), F.lit("\n\n... (truncated, "), n.cast("string"), F.lit(" lines total)"))
    return F.when(readme.isNotNull(), F.concat(F.lit("## README\n\n"), F.when(n > README_LINES, long).otherwise(short), F.lit("\n\n"))).otherwise("")


def _by(user: Column) -> Column:
    return F.when(user.isNotNull(), F.concat(F.lit(" — @"), user["login"])).otherwise("")


def _item(x: Column, middle: Column, user: Column) -> Column:
    return F.concat(F.lit("- [#"), x["number"].cast("string"), F.lit("]("), escape_md_link(x["html_url"]), F.lit(") "), x["title"], middle, _by(user), F.lit("\n"))


def _section(head: str, items: Column, line) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"## {head}\n\n"), F.array_join(F.transform(items, line), ""), F.lit("\n"))).otherwise("")


def real_issues(issues: Column) -> Column:
    """Issues that are no pull requests, of the first rows as they came: fewer than the limit may remain."""
    return F.filter(F.slice(issues, 1, OVERVIEW_ITEMS), lambda x: x["pull_request"].isNull())


def issues_section(issues: Column) -> Column:
    def line(x):
        labels = F.when(F.coalesce(F.size(x["labels"]), F.lit(0)) > 0, F.concat(F.lit(" ("), F.array_join(F.transform(x["labels"], lambda y: y["name"]), ", "), F.lit(")"))).otherwise("")
        return _item(x, labels, x["user"])

    return _section("Recent Issues", real_issues(issues), line)


def pulls_section(pulls: Column) -> Column:
    return _section("Recent Pull Requests", F.slice(pulls, 1, OVERVIEW_ITEMS), lambda x: _item(x, F.when(F.coalesce(x["draft"], F.lit(False)), " [draft]").otherwise(""), x["user"]))


def releases_section(releases: Column) -> Column:
    def line(x):
        ten = F.try_validate_utf8(F.substring(x["published_at"].cast("binary"), 1, 10).cast("string"))
        date = F.coalesce(F.when(F.octet_length(x["published_at"]) >= 10, ten), F.lit("—"))
        return F.concat(F.lit("- ["), escape_md_link(F.coalesce(x["name"], x["tag_name"])), F.lit("]("), escape_md_link(x["html_url"]), F.lit(") — "), date, F.when(x["prerelease"], " (pre-release)").otherwise(""), F.lit("\n"))

    return _section("Recent Releases", F.slice(releases, 1, OVERVIEW_RELEASES), line)


def format_overview(info: Column, readme: Column, issues: Column, pulls: Column, releases: Column, notes: Column) -> Column:
    described = F.when(info["description"].isNotNull(), F.concat(info["description"], F.lit("\n\n"))).otherwise("")
    noted = F.when(F.size(notes) > 0, F.concat(F.lit("\n> **Note:** "), F.array_join(notes, ". "), F.lit(".\n"))).otherwise("")
    return F.concat(F.lit("# "), info["full_name"], F.lit("\n\n"), described, metadata_table(info), readme_section(readme), issues_section(issues), pulls_section(pulls), releases_section(releases), noted)


def overview(repos: DataFrame, responses: DataFrame) -> DataFrame:
    """repos (key, owner, repo) with output and error: the repository's record must be there, each of the other four
    may fail and leave a note; a missing README leaves none."""
    out = repos
    for name, schema, tail in OVERVIEW_PARTS:
        out = api_rows(out.withColumn("path", repo_path(tail)), responses, schema, name).drop("path")
    out = out.withColumn("_readme", decode_base64(F.col("readme.content")))
    said = F.col("readme_error.message")
    notes = F.array_compact(
        F.array(
            F.coalesce(F.when(F.col("readme_error.kind") != "NotFound", errors.note_failed("README", said)), F.when(F.col("_readme.error").isNotNull(), F.concat(F.lit("README could not be decoded ("), F.col("_readme.error"), F.lit(")")))),
            errors.note_failed("issues", F.col("issues_error.message")),
            errors.note_failed("pull requests", F.col("pulls_error.message")),
            errors.note_failed("releases", F.col("releases_error.message")),
        )
    )
    text = format_overview(F.col("info"), F.col("_readme.text"), F.col("issues"), F.col("pulls"), F.col("releases"), notes)
    return out.select(*repos.columns, F.when(F.col("info_error").isNull(), text).alias("output"), F.col("info_error").alias("error"))


def recent(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by `order`."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
