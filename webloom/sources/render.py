"""Rendered pages: a browser's command line run as a process for each address, one at a time in a task."""

from __future__ import annotations

import os
import shlex
import shutil
import signal
import subprocess
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.schemas import RENDERED

# Limits of a process, its programs in order of choice, and what is told about failures.
RENDER_S, MAX_STDOUT, MAX_STDERR = 60, 10_000_000, 65_536
PROGRAMS = (("playwright-cli", "playwright-cli"), ("npx", "npx @playwright/cli"))
CONTENT = '"async page => { return await page.content(); }"'
NOT_INSTALLED, TIMED_OUT, FAILED = "playwright-cli not installed", "playwright-cli timed out after {}s", "playwright-cli failed: {}"


def browser_command() -> str | None:
    """The browser's command line, null where none is installed."""
    return next((command for program, command in PROGRAMS if shutil.which(program)), None)


def run_bounded(command: list[str], seconds: float, max_out: int = MAX_STDOUT, max_err: int = MAX_STDERR) -> tuple[int | None, bytes, bytes]:
    """(exit code, stdout, stderr) of a process, each pipe kept to a limit and read to its end, so that no pipe fills up. Out of
    time, the process and all that it started are killed, and the code is null."""
    process = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    kept = [bytearray(), bytearray()]

    def drain(pipe, into: bytearray, most: int) -> None:
        with pipe:
            while chunk := pipe.read1(1 << 16):
                into += chunk[: max(0, most - len(into))]

    readers = [threading.Thread(target=drain, args=x, daemon=True) for x in ((process.stdout, kept[0], max_out), (process.stderr, kept[1], max_err))]
    for r in readers:
        r.start()
    try:
        code: int | None = process.wait(timeout=seconds)
    except subprocess.TimeoutExpired:
        code = None
    if code is None or any(r.is_alive() for r in readers):
        try:
            os.killpg(process.pid, signal.SIGKILL)  # and what it left behind
        except ProcessLookupError:
            pass
        process.wait()
    for r in readers:
        r.join(timeout=5)
    return code, bytes(kept[0]), bytes(kept[1])


def render_page(url: str, command: str | None = None, seconds: float = RENDER_S) -> tuple[str, str | None, str | None]:
    """(url, stdout, failure) of an address opened, read and closed."""
    cli = command or browser_command()
    if cli is None:
        return url, None, NOT_INSTALLED
    try:
        code, out, err = run_bounded(["sh", "-c", f"{cli} open {shlex.quote(url)} && {cli} run-code {CONTENT} && {cli} close"], seconds)
    except OSError as e:
        return url, None, FAILED.format(e)
    if code is None:
        return url, None, TIMED_OUT.format(f"{seconds:g}")
    return (url, out.decode("utf-8", "replace"), None) if code == 0 else (url, None, FAILED.format(err.decode("utf-8", "replace")))


def rendered(urls: DataFrame, partitions: int = 8, render: Callable = render_page) -> DataFrame:
    """The distinct `url`s as a browser shows them (see RENDERED): a failure is a value. Write what comes back to a table before
    using it twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for url in frame["url"]:  # a page may hold 10 MB
                yield pd.DataFrame([render(url)], columns=["url", "stdout", "failure"])

    return urls.select("url").distinct().repartition(partitions, F.col("url")).mapInPandas(run, RENDERED)
