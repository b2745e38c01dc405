"""Rendering by processes, with a shell script in the browser's place."""

import time

import pytest

from webloom import schemas
from webloom.operators.fetch import to_render
from webloom.plans import commands
from webloom.sources import render

SPA = '<html><body><div id="root"></div><script src="a.js"></script></body></html>'
SHOWN = "<html><body><p>" + "shown text, " * 20 + "</p></body></html>"


def browser(tmp_path, run_code):
    script = tmp_path / "browser"
    script.write_text(f'#!/bin/sh\ncase "$1" in\nopen) echo "$2" > {tmp_path}/opened ;;\nrun-code) {run_code} ;;\nclose) echo closed >> {tmp_path}/opened ;;\nesac\n')
    script.chmod(0o755)
    return str(script)


def test_a_page_is_opened_read_and_closed(tmp_path):
    cli = browser(tmp_path, f"printf '### Result\\n\"%s\"\\n### Ran\\n' '{SHOWN}'")
    address = f"https://a.example/?q='; touch {tmp_path}/evil; echo '$(touch {tmp_path}/evil)"
    url, out, failure = render.render_page(address, cli)
    assert (url, failure) == (address, None) and out == f'### Result\n"{SHOWN}"\n### Ran\n'
    assert (tmp_path / "opened").read_text() == f"{address}\nclosed\n" and not (tmp_path / "evil").exists()


def test_failures_are_values(tmp_path, monkeypatch):
    assert render.render_page("u", browser(tmp_path, "echo broken >&2; exit 3")) == ("u", None, "playwright-cli failed: broken\n")
    start = time.monotonic()
    assert render.render_page("u", browser(tmp_path, "sleep 60 & sleep 60"), 0.5) == ("u", None, "playwright-cli timed out after 0.5s")
    assert time.monotonic() - start < 5
    monkeypatch.setenv("PATH", str(tmp_path / "none"))
    assert render.render_page("u") == ("u", None, "playwright-cli not installed")


def test_pipes_are_read_to_their_end():
    code, out, err = render.run_bounded(["sh", "-c", "head -c 30000000 /dev/zero; head -c 3000000 /dev/zero >&2"], 30, 1000, 10)
    assert code == 0 and len(out) == 1000 and len(err) == 10
    start = time.monotonic()
    assert render.run_bounded(["sh", "-c", "sleep 30 & echo done"], 20)[:2] == (0, b"done\n")  # what it leaves behind is no reason to wait
    assert time.monotonic() - start < 10


@pytest.mark.parametrize("js", [False, True])
def test_fetch_with_a_browser(spark, tmp_path, js):
    thin = "<html><body><article>" + "<p>x</p>" * 300 + "</article></body></html>"
    pages = {"https://spa.example/": SPA, "https://plain.example/": SHOWN, "https://thin.example/": thin}
    responses = spark.createDataFrame([(u, None, 200, "text/html", h.encode(), None) for u, h in pages.items()] + [("https://bad.example/", None, 404, "text/html", b"", None)], schemas.HTTP_RESPONSE)
    asked = spark.createDataFrame([(i, u, js, False) for i, u in enumerate([*pages, "https://bad.example/"])], schemas.FETCH_REQUEST)
    wanted = to_render(asked, responses)
    assert {r.url for r in wanted.collect()} == (set(pages) if js else {"https://spa.example/", "https://plain.example/", "https://thin.example/"} - ({"https://plain.example/"} if not fallback(SHOWN) else set()))

    def one(url):
        return (url, SHOWN, None) if "spa" in url else (url, "garbage", None) if "plain" in url else (url, None, "playwright-cli timed out after 60s")

    got = {r.request_id: r for r in commands.fetch(asked, responses, rendered=render.rendered(wanted, 2, one)).collect()}
    assert "shown text" in got[0].output and got[3].error.kind == "Status"
    if js:
        assert got[1].error.message == "playwright rendering failed: playwright-cli failed: could not parse playwright output" and got[1].error.exit_code == 1
        assert got[2].error.message == "playwright rendering failed: playwright-cli timed out after 60s"
    else:
        assert got[1].error is None and "shown text" in got[1].output and got[2].error is None  # they stay as they were


def fallback(html):
    from webloom.functions.html import article_of

    return article_of(html)[4]
