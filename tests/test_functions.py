import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.functions import codec
from webloom.functions import html as H
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import repo as repo_ops
from webloom.queries import QUERIES


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def each(spark, strings, f):
    df = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_markdown_helpers(spark):
    assert each(spark, ["[a](b)", "x", "\\"], T.escape_md_link) == ["\\[a\\]\\(b\\)", "x", "\\"]
    assert each(spark, ["a\r\nb\nc"], T.sanitize_heading) == ["a  b c"]
    assert each(spark, ['a"\\\n\r\t\0b'], T.escape_yaml) == ['a\\"\\\\\\n\\r\\tb']
    assert each(spark, ["a" * 200, "é" * 60, "short"], lambda s: T.truncate_with_note(s, 101)) == ["a" * 101 + "\n\n(truncated: showing 101 / 200 bytes)", "é" * 50 + "\n\n(truncated: showing 100 / 120 bytes)", "short"]
    assert each(spark, ["a\nb\n", "a\r\nb", "", "\n", "a\n\n"], T.lines) == [["a", "b"], ["a", "b"], [], [""], ["a", ""]]
    assert each(spark, [" 1-80 ", "50-", "100", "0", "", "a-b", "5-3", "3-3"], T.parse_line_range) == [(1, 80), (50, None), (1, 100), None, None, None, None, (3, 3)]


def plain_shift(md, n):
    out, fenced = [], False
    for line in re.sub(r"\r\n", "\n", md).removesuffix("\n").split("\n"):
        bare = line.lstrip("\t\x0b\f\r 　")
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and bare.startswith("#"):
            line = line[: len(line) - len(bare)] + "#" * n + bare
        out.append(line)
    return "\n".join(out)


def test_shift_headings_against_plain_version(spark):
    rng = random.Random(3)
    parts = ["# a", "  ## b", "#tag", "```", "~~~ x", "text", "", "　# w", "####### deep", "- # no", "\r\n# crlf\r\n", "`# no`"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n"]) for _ in range(400)]
    assert each(spark, texts, lambda s: T.shift_headings(s, 2)) == [plain_shift(t, 2) for t in texts]
    assert each(spark, texts, lambda s: T.shift_headings(s, 0)) == texts


def test_pages(spark):
    pages = ["<body>" + "x" * 99 + "</body>", "<body>" + "x" * 100 + "</body>", "<BODY><STYLE>" + "p" * 300 + "</STYLE></BODY>", "<body>   \n  </body>", '<div id="app"></div>', "plain " * 50 + '<div id="app"></div>', "<body>a<script>x</script></body>", "<body>a<SCRIPT>x</SCRIPT></body>"]
    assert each(spark, pages, H.has_thin_body) == [True, False, True, True, True, False, True, True]
    assert each(spark, pages, H.is_js_dependent) == [False, False, False, False, True, False, True, False]
    assert each(spark, ["<title> A b </title>", "<TITLE x=1>é</TITLE>", "<title></title>", "none", "<title>&amp;\n</title>"], H.extract_title) == ["A b", "é", None, None, "&amp;"]
    assert each(spark, ["<p>a b</p> c", "<script>xy</script>", "x < y"], H.visible_text_len) == [3, 2, 1]
    out = ['### Result\n"<html>\\n</html>"\n### Next', '"<html>"', "noise <body>x</body>", '### Result\n"broken', "garbage"]
    assert each(spark, out, H.parse_renderer_output) == ["<html>\n</html>", "<html>", "noise <body>x</body>", None, None]


def test_article_and_markdown():
    body = "".join(f"<p>Paragraph {i} has <b>bold</b> words, a <a href='/l{i}'>link</a>, and enough text to count as one that a reader would read to its end, surely.</p>" for i in range(6))
    html = f"<html><head><title>T &amp; t</title><meta name=author content=Ann><meta property='article:published_time' content=2024-01-02></head><body><nav>menu</nav><article><h1>Head</h1>{body}<ul><li>one<li>two</ul><pre>a\n  b</pre></article><footer>foot</footer></body></html>"
    title, byline, date, content, fallback = H.article_of(html)
    assert (title, byline, date, fallback) == ("T &amp; t", "Ann", "2024-01-02", False)
    assert "menu" not in content and "foot" not in content
    md = H.markdown_of(content)
    assert md.startswith("# Head\n\nParagraph 0 has **bold** words, a [link](/l0), and")
    assert "- one\n- two" in md and "```\na\n  b\n```" in md
    assert H.article_of("<p>short</p>") == (None, None, None, "<p>short</p>", True)
    assert H.markdown_of("<table><tr><th>a<th>b</tr><tr><td>1<td>2|</tr></table>") == "| a | b |\n| --- | --- |\n| 1 | 2\\| |\n"
    assert H.markdown_of("<div>" * 3000 + "deep" + "</div>" * 3000).strip() == "deep"
    assert H.markdown_of("") == ""


def test_codec(spark):
    got = each(spark, ["aGk=", "a G\nk=", "%%", "/w=="], codec.decode_base64)
    assert [g.text for g in got] == ["hi", "hi", None, None] and got[0].error is None and "base64" in got[2].error and "binary" in got[3].error
    df = spark.createDataFrame([(b"\x83\x65\x83\x58", "shift_jis"), (b"\xff\xfea", None), (b"caf\xe9", "iso-8859-1"), (b"ok", "nonsense"), (None, "utf-8")], "b binary, c string")
    assert [r[0] for r in df.select(codec.decode_body(F.col("b"), F.col("c"))).collect()] == ["テス", "��a", "café", "ok", None]
    assert each(spark, ['{"message":"m"}', "x" * 300, "[]"], codec.error_message) == ["m", "x" * 200, "[]"]


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.rs", ["a.rs", ".rs"], ["a.rs.x", "a.py"]), ("*.{ts,tsx}", ["a.ts", "b.tsx"], ["c.tsz"]), ("a?c", ["abc"], ["ac"]), ("[!a-c]x", ["dx"], ["ax"]), ("[ab].md", ["a.md"], ["c.md"]), ("**", ["any"], [])])
def test_globs(spark, glob, yes, no):
    assert each(spark, yes + no, lambda s: s.rlike(U.glob_regex(glob))) == [True] * len(yes) + [False] * len(no)


def test_bad_globs():
    for bad in ("[a", "{a,b", "a}", "[z-a]"):
        with pytest.raises(ValueError):
            U.glob_regex(bad)


def test_tree_filter_names_a_bad_glob(spark):
    from webloom.errors import PipelineError

    with pytest.raises(PipelineError) as e:
        repo_ops.filter_tree(spark.createDataFrame([("a", "blob")], "path string, type string"), None, "[a")
    assert e.value.exit_code == 1


def test_private_addresses():
    assert all(map(U.is_private_ip, ("127.0.0.1", "10.9.9.9", "100.127.255.255", "0.1.2.3", "255.255.255.255", "::", "fe80::1", "fd00::1", "::ffff:192.168.1.1")))
    assert not any(map(U.is_private_ip, ("8.8.8.8", "100.128.0.1", "2001:db8::1", "::ffff:8.8.8.8", "172.32.0.1")))


def test_half_even_sizes(spark):
    got = [r[0] for r in spark.createDataFrame([(1023,), (1024,), (39168,), (1048576,), (0,)], "n long").select(T.format_size(F.col("n"))).collect()]
    assert got == ["1023 B", "1.0 KB", "38.2 KB", "1.0 MB", "0 B"]


def plain_body_bytes(html):
    """The body's visible bytes, character by character."""
    start = re.search("<body", html, re.I)
    body = html
    if start:
        close = html.find(">", start.start())
        body = html[close + 1 if close >= 0 else start.start() :]
        end = re.search("</body>", body, re.I)
        body = body[: end.start()] if end else body
    out, in_tag, name, reading, skip = [], False, "", False, False
    for c in body:
        if c == "<":
            in_tag, name, reading = True, "", True
        elif c == ">" and in_tag:
            in_tag = False
            if name.lower() in ("script", "style"):
                skip = True
            elif name.lower() in ("/script", "/style"):
                skip = False
        elif in_tag:
            if reading and (c.isascii() and c.isalnum() or c == "/"):
                name += c
            else:
                reading = False
        elif not skip:
            out.append(c)
    return len(re.sub(r"\s+", " ", "".join(out)).strip().encode())


def test_body_bytes_against_plain_version(spark):
    rng = random.Random(5)
    parts = ["<body>", "</body>", "<BODY x=1", ">", "<", "<script>", "</script>", "<style a>", "</STYLE >", "<script/>", "text", " ", "é", "\n", "<b", "<scripts>", "</script", "a>b", "<<script>", "<x <style>", "<p>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert each(spark, pages, H.body_text_bytes) == [plain_body_bytes(p) for p in pages]


def test_pages_are_read_once(spark):
    """Pages made to be read again and again, of a megabyte each."""
    n = 1_000_000
    pages = ["<body>" + "<" * n, "<" * n, "<script>" * (n // 8), "<script><" * (n // 9), "<body" * (n // 5), "<title" * (n // 6), "<title>" * (n // 7), "</script" * (n // 8) + ">", "<body>" + "<script " * (n // 8)]
    assert all(x in (True, False) for x in each(spark, pages, H.is_js_dependent))
    assert each(spark, pages, H.extract_title) == [None] * len(pages)
    nested = "<div>" * 20_000 + "<p>" + "word, " * 100 + "</p>"
    assert H.article_of(nested)[4] is False


def test_charsets(spark):
    types = ["text/html; charset=hex", "text/html;charset='shift_jis'", 'text/html; x=y; CHARSET="EUC-KR"', "text/html; charset=", 'text/html; charset=""; charset=utf-8', "charset=utf-8", "text/html; charset = latin1", None]
    assert each(spark, types, codec.extract_charset) == ["hex", "'shift_jis'", "euc-kr", None, "utf-8", None, None, None]
    labels = ["hex", "rot13", "idna", "undefined", "base64", "'shift_jis'", "unicode_escape", "x-sjis", "windows-1251", "l2"]
    df = spark.createDataFrame([(b"\xe9\x82", c) for c in labels], "b binary, c string")
    got = [r[0] for r in df.select(codec.decode_body(F.col("b"), F.col("c"))).collect()]
    assert got[:7] == ["�"] * 7 and got[7:] == [b"\xe9\x82".decode("cp932"), "й‚", "é\x82"]
    assert all("é".encode(name, "replace") is not None for name in codec.ENCODINGS)


def test_lines_are_split_once(spark):
    """However many ranges are asked and however often a range names its lines."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(QUERIES["line_range"](spark, "/root/testdata/sf0.001")).count("split(") == 1
    row = spark.createDataFrame([("a\nb",)], "t string")
    assert plan(row.select(T.apply_line_range(F.col("t"), F.lit(1), F.lit(None)).alias("x"))).count("split(") <= 1


def test_line_numbers_of_more_than_five_digits(spark):
    row = spark.range(1).select(F.repeat(F.lit("x\n"), 100_001).alias("t"))
    assert row.select(T.apply_line_range(F.col("t"), F.lit(99_999), F.lit(None))).first()[0] == "99999\tx\n100000\tx\n100001\tx"


def test_base64_is_decoded_once(spark):
    row = spark.createDataFrame([("YQ==",), ("%%",), ("/w==",), (None,)], "b string").select(codec.decode_base64(F.col("b")).alias("d"))
    assert [tuple(r[0]) for r in row.collect()] == [("a", None), (None, "Content decode error: invalid base64"), (None, "Content decode error: binary file (not UTF-8)"), (None, None)]
    both = row.select("d.text", "d.error")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("to_binary(") <= 1


def test_rows_that_ask_for_nothing_are_spread(spark):
    """Files with content have no blob to ask for; they do not all meet in the join's task for null."""
    responses = spark.createDataFrame([("/p", 200, None, '{"content": "c"}')], "path string, status int, remaining long, body string")
    wanted = spark.range(1000).select("id", F.when(F.col("id") == 7, "/p").alias("path"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = repo_ops.api_rows(wanted, responses, "content string", "x").withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 1000 and len({r["at"] for r in got}) > 4
    assert {r.id: (r.x.content if r.x else None, r.x_error.kind if r.x_error else None, r.path) for r in got} == {i: ("c", None, "/p") if i == 7 else (None, "Network", None) for i in range(1000)}
