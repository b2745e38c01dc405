import base64
import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from webloom import cli, schemas
from webloom.operators import repo as repo_ops
from webloom.plans import commands
from webloom.sources import credentials, live, recorded
from webloom.streaming import pages as page_stream

ARTICLE = "<html><head><title>T</title></head><body><article><h1>H</h1>" + "<p>A sentence that is long enough to be taken for the text of an article by anyone, with commas, too, and more words so that it counts.</p>" * 6 + "</article></body></html>"
SPA = '<html><body><div id="root"></div><script src="a.js"></script></body></html>'


def answer(text, *sources):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}, "groundingMetadata": {"groundingChunks": [{"web": {"uri": u, "title": t}} for u, t in sources]}}]})


def rows(df):
    return {r[0]: r for r in df.collect()}


def pages(spark, *more):
    base = [("https://a.example/", None, 200, "text/html", ARTICLE.encode(), None), ("https://spa.example/", None, 200, "text/html", SPA.encode(), None), ("https://b.example/", None, 500, "text/html", b"", None), ("https://pdf.example/", None, 200, "application/pdf", b"", None), ("https://hop.example/", "http://127.0.0.1/", 200, "text/html", b"x", None), ("https://slow.example/", None, None, None, None, "Timeout"), ("https://big.example/", None, 200, "text/html", b"x" * 10_000_001, None)]
    return spark.createDataFrame([*base, *more], schemas.HTTP_RESPONSE)


def test_fetch(spark):
    urls = ["https://a.example/", "https://spa.example/", "https://b.example/", "https://pdf.example/", "https://hop.example/", "https://slow.example/", "https://none.example/", "ftp://x", "http://10.0.0.1/", "https://big.example/"]
    asked = spark.createDataFrame([(i, u, False, False) for i, u in enumerate(urls)] + [(20, "https://a.example/", False, True), (21, "https://a.example/", True, False), (22, "https://spa.example/", True, False), (23, "https://team.slack.com/archives/C1/p1700000000123456", False, False)], schemas.FETCH_REQUEST)
    rendered = spark.createDataFrame([("https://spa.example/", "### Result\n" + json.dumps(ARTICLE), None)], schemas.RENDERED)
    got = rows(commands.fetch(asked, pages(spark), rendered=rendered))
    assert got[0].output.startswith('---\ntitle: "T"\n---\n\n### H\n\nA sentence') and got[0].error is None
    assert got[1].output == got[0].output == got[22].output
    kinds = {i: (got[i].error.kind, got[i].error.exit_code) for i in (2, 3, 4, 5, 6, 7, 8, 9, 21)}
    assert kinds == {2: ("Status", 2), 3: ("UnsupportedContentType", 1), 4: ("InternalHost", 1), 5: ("Timeout", 2), 6: ("Http", 2), 7: ("InvalidScheme", 1), 8: ("InternalHost", 1), 9: ("TooLarge", 2), 21: ("Playwright", 1)}
    assert got[2].error.message == "fetch failed: status 500"
    assert "### H" in got[20].output and got[20].error is None
    assert got[23].error.kind == "TokenNotSet"
    plain = rows(commands.fetch(asked.filter("request_id = 1"), pages(spark)))
    assert plain[1].output.startswith("> Note: Readability extraction failed.")


def test_search_and_research(spark):
    asked = spark.createDataFrame([(1, "型安全 TypeScript", 2, "auto"), (2, "down", 3, "auto"), (3, "x", 3, "ja")], schemas.RESEARCH_REQUEST)
    answers = spark.createDataFrame([("型安全 TypeScript", 200, answer("one", ("https://a.example/", "A"), ("https://b.example/", "B [x]"))), ("TypeScript", 200, answer("two", ("https://a.example/", "again"), ("https://c.example/", ""))), ("down", 429, ""), ("x (日本語で回答)", 200, answer("three"))], "search_query string, status int, body string")
    got = rows(commands.research(asked, answers, pages(spark)))
    text = got[1].report
    assert text.startswith("# Research: 型安全 TypeScript\n\n## Search Result 1\n\none\n\n## Search Result 2\n\ntwo\n\n---\n\n## Fetched Pages\n\n### https://a.example/\n\n---\n")
    assert "## Failed URLs\n\n- https://b.example/ (fetch failed: status 500)\n\n## Sources\n\n- [A](https://a.example/)\n- [B \\[x\\]](https://b.example/)\n- [](https://c.example/)\n" in text
    assert "#### H" in text
    assert got[2].report is None and got[2].error.kind == "RateLimited"
    assert got[3].report == "# Research: x\n\nthree\n\n"
    one = rows(commands.search(spark.createDataFrame([(1, "型安全 TypeScript", "auto"), (2, "q", "auto")], "request_id long, query string, lang string"), answers))
    assert one[1].output == "one\n\n---\n**Sources:**\n- [A](https://a.example/)\n- [B \\[x\\]](https://b.example/)\n"
    assert one[2].error.kind == "Network"


def b64(text):
    return base64.b64encode(text.encode()).decode()


def api(spark):
    tree = {"truncated": True, "tree": [{"path": "src/b.rs", "type": "blob", "size": 2048}, {"path": "src", "type": "tree"}, {"path": "src2/a.rs", "type": "blob", "size": 5}, {"path": "src/m.md", "type": "blob"}]}
    info = {"full_name": "o/r", "html_url": "https://x/o/r", "default_branch": "main", "stargazers_count": 1, "forks_count": 2, "open_issues_count": 3, "license": {"name": "Own"}}
    found = [("/repos/o/r", 200, info), ("/repos/o/r/git/trees/main?recursive=1", 200, tree), ("/repos/o/r/contents/a%20b.txt", 200, {"sha": "s", "content": b64("l1\nl2\nl3\n")}), ("/repos/o/r/contents/big.bin?ref=v1", 200, {"sha": "s2"}), ("/repos/o/r/git/blobs/s2", 200, {"content": b64("from blob")}), ("/repos/o/r/contents/raw", 200, {"sha": "x", "content": "/w=="}), ("/repos/o/r/contents/empty", 200, {"sha": "x", "content": ""}), ("/repos/o/r/readme", 404, {"message": "no"}), ("/repos/o/r/issues?" + repo_ops.RECENT, 403, {"message": "no scope"}), ("/repos/o/r/pulls?" + repo_ops.RECENT, 200, [{"number": 4, "title": "P", "html_url": "u", "draft": True, "user": None}]), ("/repos/o/r/releases?per_page=3", 200, [{"tag_name": "v1", "html_url": "u(1)", "published_at": "2024-05-06T00:00:00Z", "prerelease": True}, {"tag_name": "v0", "name": "old", "html_url": "u", "prerelease": False}])]
    return spark.createDataFrame([(p, s, 50, json.dumps(b)) for p, s, b in found], schemas.API_RESPONSE)


def test_repositories(spark):
    asked = spark.createDataFrame([(1, "o/r", None), (2, "https://github.com/o/r.git", "main"), (3, "bad", None), (4, "o/none", None), (5, "o/r", "a..b")], "request_id long, repository string, ref string")
    got = rows(commands.repo_tree(asked, api(spark), "src", "*.rs"))
    want = "o/r (ref: main)\nfiles: 2 (tree truncated by GitHub — repository exceeds API limits)\n\nsrc/b.rs (2.0 KB)\nsrc2/a.rs (5 B)\n"
    assert got[1].output == got[2].output == want
    assert [got[i].error.kind for i in (3, 4, 5)] == ["InvalidRepo", "Network", "InvalidRef"]
    assert rows(commands.repo_tree(asked.limit(1), api(spark), None, "[x"))[1].error.kind == "InvalidPattern"
    files = [(1, "o/r", "a b.txt", None, None), (2, "o/r", "a b.txt", None, "2-9"), (3, "o/r", "big.bin", "v1", None), (4, "o/r", "raw", None, None), (5, "o/r", "a b.txt", None, "9-"), (6, "o/r", "../x", None, None), (7, "o/r", "a b.txt", None, "x"), (8, "o/r", "empty", None, None)]
    read = rows(commands.repo_read(spark.createDataFrame(files, "request_id long, repository string, file string, ref string, lines string"), api(spark)))
    assert read[1].output == "a b.txt (3 lines)\n\n    1\tl1\n    2\tl2\n    3\tl3"
    assert read[2].output == "a b.txt (3 lines)\n\n    2\tl2\n    3\tl3" and read[3].output == "big.bin (1 lines)\n\n    1\tfrom blob"
    assert read[5].output == "a b.txt (3 lines)\n\n(file has 3 lines, requested start at 9)"
    assert read[8].output == "empty (0 lines)\n\n(file has 0 lines, requested start at 1)"
    assert [read[i].error.kind for i in (4, 6, 7)] == ["Decode", "InvalidPath", "InvalidLineRange"]
    over = rows(commands.repo_overview(asked.select("request_id", "repository").filter("request_id in (1, 3, 4)"), api(spark)))
    assert over[1].output == (
        "# o/r\n\n| Attribute | Value |\n|-----------|-------|\n| Stars | 1 |\n| Forks | 2 |\n| Open Issues | 3 |\n| License | Own |\n| Default Branch | main |\n| URL | https://x/o/r |\n\n"
        "## Recent Pull Requests\n\n- [#4](u) P [draft]\n\n## Recent Releases\n\n- [v1](u\\(1\\)) — 2024-05-06 (pre-release)\n- [old](u) — —\n\n"
        "\n> **Note:** Could not fetch issues (Access denied: no scope — check that your GITHUB_TOKEN has the required scopes).\n"
    )
    assert over[3].error.kind == "InvalidRepo" and over[4].error.kind == "Network"


def chat(spark):
    messages = spark.createDataFrame([("C1", "1.000100", "1.000100", "U1", "hi <@U2|b> <@U9>", 2), ("C1", "1.000200", "1.000100", "U2", "re", None), ("C1", "1.000300", "1.000100", None, "bot", None), ("C1", "2.000000", None, "U1", "alone\n", 0)], schemas.MESSAGES)
    return messages, spark.createDataFrame([("U1", "One", ""), ("U2", "Two", "two")], schemas.USERS), spark.createDataFrame([("C1", "general")], schemas.CHANNELS)


def test_threads(spark):
    url = "https://team.slack.com/archives/{}/p{}"
    asked = [(1, url.format("C1", "1000100"), False, False), (2, url.format("C1", "1000200") + "?thread_ts=1.000100", False, False), (3, url.format("C1", "2000000"), False, False), (4, url.format("C9", "2000000"), False, False)]
    got = rows(commands.fetch(spark.createDataFrame(asked, schemas.FETCH_REQUEST), recorded.empty(spark, "responses"), chat=chat(spark)))
    body = "---\n\nhi @two @U9\n\n---\n\ntwo (1.000200):\nre\n\n---\n\n(no author) (1.000300):\nbot\n"
    head = '---\nworkspace: "team"\nchannel: "#general"\nauthor: "One"\nts: "{}"\nreplies: 2\nurl: "{}"\n'
    assert got[1].output == head.format("1.000100", asked[0][1]) + body
    assert got[2].output == head.format("1.000200", asked[1][1]) + body
    assert got[3].output.endswith("---\n\nalone\n") and "replies" not in got[3].output
    assert got[4].error.message == "Slack API error: message not found"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/hop":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        status = {"/page": 200, "/big": 200}.get(self.path, 404)
        self.send_response(status)
        self.send_header("Content-Type", "text/html")
        if self.path == "/big":
            self.send_header("Content-Length", "20000000")
        self.end_headers()
        self.wfile.write(ARTICLE.encode())

    def log_message(self, *args):
        pass


def test_live_pages(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    anywhere = lambda url: live.get_page(url, blocked=lambda ip: False)
    got = rows(live.pages(spark.createDataFrame([(base + p,) for p in ("/page", "/hop", "/big", "/none")], "url string"), get=anywhere))
    assert got[base + "/page"].status == 200 and bytes(got[base + "/page"].body) == ARTICLE.encode()
    assert got[base + "/hop"].final_url == base + "/page" and got[base + "/big"].failure == "TooLarge" and got[base + "/none"].status == 404
    server.shutdown()
    assert live.get_page(base + "/page")[5] == "InternalHost"
    assert live.get_page("http://name.example/", resolver=lambda h, p: ["10.0.0.1"])[5] == "InternalHost"

    def unknown(host, port):
        raise socket.gaierror

    assert live.get_page("http://name.example/", resolver=unknown)[5] == "DnsResolution"


def test_live_api_and_retry(spark):
    waits, seen = [], []
    out = live.retry_with(lambda: seen.append(1) or len(seen), lambda x: x < 3, waits.append)
    assert out == 3 and len(waits) == 2 and 0.5 <= waits[0] < 1 <= waits[1] < 2
    assert live.jittered_backoff(0, lambda: 0) == 0.5
    got = rows(live.repo_api(spark.createDataFrame([("/repos/o/r",), (None,)], "path string"), once=lambda p: (p, 200, 9, "{}")))
    assert got["/repos/o/r"].status == 200 and len(got) == 1
    with pytest.raises(ValueError):
        live.repo_api(spark.createDataFrame([("/x",)], "path string"), token=credentials.Secret("t"), base="http://x.example")
    found = rows(live.search_api(spark.createDataFrame([("q",)], "search_query string"), credentials.Secret("k"), "m", once=lambda q: (q, 200, None, answer("a"))))
    assert found["q"].body == answer("a")
    calls = [("/conversations.replies?channel=C1&ts=1.000100", json.dumps({"ok": True, "messages": [{"user": "U1", "text": "t", "ts": "1.000100"}]})), ("/users.info?user=U1", json.dumps({"ok": True, "user": {"real_name": "One", "profile": {"display_name": ""}}})), ("/conversations.info?channel=C1", json.dumps({"ok": True, "channel": {"name": "general"}})), ("/users.info?user=U2", json.dumps({"ok": False, "error": "user_not_found"}))]
    said = live.chat_api(spark.createDataFrame([(c[0],) for c in calls], "path string"), credentials.Secret("k"), once=lambda p: (p, 200, None, dict(calls)[p])).persist()
    assert rows(said)["/users.info?user=U2"].api_error == "user_not_found"
    messages, users, channels = live.chat_tables(said)
    assert messages.first().thread_ts == "1.000100" and users.collect() == [("U1", "One", "")] and channels.first().name == "general"
    hosts = live.resolved(spark.createDataFrame([("https://n.example/x",), ("http://1.2.3.4/",), ("nope",)], "url string"), resolver=lambda h, p: ["9.9.9.9"])
    assert hosts.collect() == [("n.example", "9.9.9.9")]


def test_live_rounds(spark):
    held = {r.path: r for r in api(spark).collect()}
    ask = lambda new: live.repo_api(new, once=lambda p: (p, held[p].status, 50, held[p].body) if p in held else (p, 404, 50, "{}"))
    none = recorded.empty(spark, "api")
    tree = spark.createDataFrame([(1, "o/r", None)], "request_id long, repository string, ref string")
    got = live.complete(lambda known: commands.repo_paths(tree, known), ask, none)
    assert rows(commands.repo_tree(tree, got))[1].output.startswith("o/r (ref: main)\nfiles: 3")
    read = spark.createDataFrame([(1, "o/r", "big.bin", "v1", None)], "request_id long, repository string, file string, ref string, lines string")
    got = live.complete(lambda known: commands.repo_paths(read, known), ask, none)
    assert rows(commands.repo_read(read, got))[1].output.endswith("    1\tfrom blob")
    over = spark.createDataFrame([(1, "o/r")], "request_id long, repository string")
    got = live.complete(lambda known: commands.repo_paths(over, known), ask, none)
    assert got.count() == 5 and rows(commands.repo_overview(over, got))[1].output.startswith("# o/r\n")
    ok = lambda **x: json.dumps({"ok": True} | x)
    bodies = {"/conversations.history?channel=C1&latest=1.000100&inclusive=true&limit=1": ok(messages=[{"user": "U1", "text": "<@U2>", "ts": "1.000100", "reply_count": 1}]), "/conversations.info?channel=C1": ok(channel={"name": "g"}), "/conversations.replies?channel=C1&ts=1.000100": ok(messages=[{"user": "U1", "text": "<@U2>", "ts": "1.000100"}, {"user": "U3", "text": "re", "ts": "1.000200"}]), "/users.info?user=U1": ok(user={"real_name": "One"}), "/users.info?user=U2": ok(user={"profile": {"display_name": "two"}}), "/users.info?user=U3": json.dumps({"ok": False, "error": "x"})}
    asked = spark.createDataFrame([(1, "https://t.slack.com/archives/C1/p1000100", False, False)], schemas.FETCH_REQUEST)
    links = asked.selectExpr("request_id AS key", "named_struct('workspace', 't', 'channel', 'C1', 'ts', '1.000100', 'thread_ts', CAST(NULL AS STRING), 'raw_url', url) AS link")
    said = live.complete(lambda known: live.chat_calls(links, known), lambda new: live.chat_api(new, credentials.Secret("k"), once=lambda p: (p, 200, None, bodies[p])), spark.createDataFrame([], "path string, body string, api_error string"), 4)
    text = rows(commands.fetch(asked, recorded.empty(spark, "responses"), chat=live.chat_tables(said)))[1].output
    assert 'channel: "#g"\nauthor: "One"' in text and text.endswith("@two\n\n---\n\nU3 (1.000200):\nre\n")


def test_credentials():
    assert repr(credentials.Secret(" s ")) == "[REDACTED]" and credentials.Secret(" s ").expose() == "s"
    assert credentials.repo_token({"GITHUB_TOKEN": " ", "GH_TOKEN": "b"}).expose() == "b"
    assert credentials.repo_token({}, lambda: "c").expose() == "c" and credentials.repo_token({}, lambda: None) is None
    assert credentials.search_key({"GEMINI_API_KEY": "k"})[1] == credentials.DEFAULT_MODEL
    for f in (credentials.search_key, credentials.chat_token):
        with pytest.raises(Exception, match="not set") as e:
            f({})
        assert e.value.exit_code == 1


def test_stream(spark, tmp_path):
    recorded.write(pages(spark).filter("url <> 'https://big.example/'"), str(tmp_path), "responses")
    for _ in range(2):  # the second run finds nothing new
        query = page_stream.start(spark, f"{tmp_path}/responses", f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination(120)
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert len(got) == 6 and got["https://a.example/"].markdown.startswith("---\n") and got["https://b.example/"].error.kind == "Status"


def test_cli(spark, tmp_path, capsys):
    recorded.write(pages(spark).filter("url = 'https://a.example/'"), str(tmp_path), "responses")
    recorded.write(api(spark), str(tmp_path), "api")
    for name in ("messages", "users", "channels"):
        recorded.write(recorded.empty(spark, name), str(tmp_path), name)
    recorded.write(spark.createDataFrame([("q", 200, answer("A", ("https://a.example/", "t")))], recorded.TABLES["search"]), str(tmp_path), "search")
    base = ["--recorded", str(tmp_path)]
    assert cli.main([*base, "fetch", "https://a.example/"], spark) == 0
    assert cli.main([*base, "search", "q"], spark) == 0
    assert cli.main([*base, "research", "q", "-d", "1"], spark) == 0
    assert cli.main([*base, "repo-tree", "o/r", "--pattern", "*.md"], spark) == 0
    assert cli.main([*base, "repo-read", "o/r", "a b.txt", "-l", "1"], spark) == 0
    assert cli.main([*base, "repo-overview", "o/r"], spark) == 0
    text = capsys.readouterr().out
    assert "# Research: q" in text and "src/m.md\n" in text and "    1\tl1\n" in text and text.endswith("\n")
    assert cli.main([*base, "fetch", "ftp://x"], spark) == 1
    assert cli.main([*base, "fetch", "https://none.example/"], spark) == 2
    assert "error: invalid URL: must be HTTP(S)" in capsys.readouterr().err


def test_local_search_reads_the_documents_once(spark):
    from webloom.operators.research import local_search

    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [(i, f"common word{i % 7} rare{i}") for i in range(50)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "doc_id long, text string")
    asked = spark.createDataFrame([("common rare3",), ("word2 common",), ("nothing",)], "search_query string")
    got = {r.search_query: r.body for r in local_search(asked, docs, 2).collect()}
    assert read.value == 50
    uris = {q: [c for c in (f"doc://{i}" for i in range(50)) if f'"{c}"' in body] for q, body in got.items()}
    assert uris == {"common rare3": ["doc://0", "doc://3"], "word2 common": ["doc://2", "doc://9"]}
