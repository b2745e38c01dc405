"""Logs of exchanges, places of mentions and long threads."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions.html import OUTPUT_BYTES
from webloom.operators import threads as thread_ops
from webloom.operators.exchanges import latest
from webloom.plans import commands
from webloom.sources import recorded

DAY = [datetime.datetime(2024, 1, d) for d in range(1, 6)]
PAGE = "<p>page {}</p>"


def at(day):
    return F.lit(DAY[day])


def response(url, text, status=200):
    return (url, url, status, "text/html", PAGE.format(text).encode(), None)


def test_two_crawls_one_row(spark, tmp_path):
    folder = str(tmp_path / "log")
    write = lambda day, *rows: recorded.write(spark.createDataFrame(list(rows), schemas.HTTP_RESPONSE), folder, "responses", at(day))
    write(0, response("https://a.example/", "old"), response("https://b.example/", "b"))
    write(2, response("https://a.example/", "new"), response("https://a.example/", "new"))  # twice at one time
    asked = spark.createDataFrame([(1, "https://a.example/", False, True), (2, "https://b.example/", False, True), (3, "https://c.example/", False, True)], schemas.FETCH_REQUEST)

    def fetched(responses):
        rows = commands.fetch(asked, responses).collect()
        assert len(rows) == 3
        return {r.request_id: r.output and r.output.split("\n")[-1] for r in rows}

    assert fetched(recorded.read(spark, folder, "responses")) == {1: "page new", 2: "page b", 3: None}
    assert fetched(recorded.log(spark, folder, "responses")) == {1: "page new", 2: "page b", 3: None}  # a log itself, too
    assert fetched(recorded.read(spark, folder, "responses", at="2024-01-02")) == {1: "page old", 2: "page b", 3: None}
    assert fetched(recorded.read(spark, folder, "responses", at="2023-01-01")) == {1: None, 2: None, 3: None}
    recorded.compact(spark, folder, "responses", str(tmp_path / "small"))
    kept = recorded.log(spark, str(tmp_path / "small"), "responses")
    assert sorted((r.url, r.recorded_at) for r in kept.collect()) == [("https://a.example/", DAY[2]), ("https://b.example/", DAY[0])]
    recorded.write(spark.createDataFrame([response("https://b.example/", "later")], schemas.HTTP_RESPONSE), str(tmp_path / "small"), "responses", at(3))
    assert fetched(recorded.read(spark, str(tmp_path / "small"), "responses")) == {1: "page new", 2: "page later", 3: None}


def test_a_names_addresses_belong_together(spark, tmp_path):
    write = lambda day, *rows: recorded.write(spark.createDataFrame(list(rows), schemas.RESOLVED), str(tmp_path), "resolved", at(day))
    write(0, ("a", "1.1.1.1"), ("a", "2.2.2.2"), ("b", "3.3.3.3"))
    write(1, ("a", "4.4.4.4"), ("a", "5.5.5.5"))
    assert sorted(map(tuple, recorded.read(spark, str(tmp_path), "resolved").collect())) == [("a", "4.4.4.4"), ("a", "5.5.5.5"), ("b", "3.3.3.3")]


def test_searches_and_repositories_by_log(spark):
    body = lambda text: json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})
    log = spark.createDataFrame([("q", 200, body("one"), DAY[0]), ("q", 200, body("two"), DAY[1]), ("q", 429, "", None)], "search_query string, status int, body string, recorded_at timestamp")
    asked = spark.createDataFrame([(1, "q", "auto")], "request_id long, query string, lang string")
    (row,) = commands.search(asked, log).collect()
    assert row.output.startswith("two") and row.error is None
    info = lambda branch: json.dumps({"full_name": "o/r", "html_url": "u", "default_branch": branch, "stargazers_count": 1, "forks_count": 1, "open_issues_count": 1})
    tree = json.dumps({"tree": [{"path": "a", "type": "blob", "size": 1}], "truncated": False})
    api = spark.createDataFrame([("/repos/o/r", 200, 9, info("old"), DAY[0], "x"), ("/repos/o/r", 200, 9, info("new"), DAY[1], "y"), ("/repos/o/r", 404, 9, "{}", DAY[1], "a"), ("/repos/o/r/git/trees/new?recursive=1", 200, 9, tree, DAY[0], "z")], schemas.API_RESPONSE + ", recorded_at timestamp, version string")
    (row,) = commands.repo_tree(spark.createDataFrame([(1, "o/r", None)], "request_id long, repository string, ref string"), api).collect()
    assert row.output.startswith("o/r (ref: new)")


def test_tables_without_a_time_stay(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "key long, v string")
    assert latest(df, "key") is df
    none = spark.createDataFrame([(1, "a", None), (None, "b", DAY[0]), (None, "c", DAY[1])], "key long, v string, recorded_at timestamp")
    assert sorted(map(str, latest(none, "key").collect())) == ["Row(key=1, v='a')", "Row(key=None, v='c')"]


@pytest.mark.parametrize("text", ["", "<@U1>", "é <@U1|ann> x <@U2> <@open", "<@><@|x>y<@é|b>", "no", "<@a\nb>"])
def test_mention_spans(spark, text):
    want, data, i = [], text.encode(), 0
    while (i := data.find(b"<@", i)) >= 0 and (end := data.find(b">", i)) >= 0:
        want.append((data[i + 2 : end].split(b"|")[0].decode(), i, end + 1))
        i = end + 1
    got = spark.createDataFrame([(text,)], "t string").select(thread_ops.mention_spans(F.col("t"))).first()[0]
    assert [tuple(x) for x in got] == want


def test_null_has_no_spans(spark):
    assert spark.createDataFrame([(None,)], "t string").select(thread_ops.mention_spans(F.col("t"))).first()[0] is None


@pytest.mark.parametrize(("size", "n"), [(10, 3), (30_000, 12), (100, 1500)])
def test_long_threads_are_cut_as_if_whole(spark, size, n):
    said = [("C", f"1.{i:06d}", "1.000000", "U" if i % 3 else None, f"é{i} " + "x" * size + ("\n" if i % 2 else ""), None) for i in range(n)]
    link = ("w", "C", "1.000001", "1.000000", "url")
    links = spark.createDataFrame([(1, link), (2, ("w", "D", "1.000001", None, "url"))], f"key long, link {schemas.PERMALINK}")
    tables = spark.createDataFrame(said, schemas.MESSAGES), spark.createDataFrame([("U", "Ann", None)], schemas.USERS), spark.createDataFrame([("C", "general")], schemas.CHANNELS)
    got = {r.key: r for r in thread_ops.fetch_threads(links, *tables).collect()}
    author = lambda i: "Ann" if i % 3 else "(no author)"
    whole = f'---\nworkspace: "w"\nchannel: "#general"\nauthor: "(no author)"\nts: "1.000001"\n' + (f"replies: {n - 1}\n" if n > 1 else "") + 'url: "url"\n---\n\n' + said[0][4]
    whole += "".join(f"\n\n---\n\n{author(i)} ({said[i][1]}):\n{said[i][4]}" for i in range(1, n))
    whole += "" if whole.endswith("\n") else "\n"
    data = whole.encode()
    if len(data) > OUTPUT_BYTES:
        head = data[:OUTPUT_BYTES].decode("utf-8", "ignore")
        whole = f"{head}\n\n(truncated: showing {len(head.encode())} / {len(data)} bytes)"
    assert got[1].output == whole and got[2].error.message and got[2].output is None
