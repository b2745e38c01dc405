"""Live sources: each turns a DataFrame of requests into the table of recorded exchanges that the plans read.

Requests are spread over partitions; a partition keeps a few of them in flight. Write what comes back to a table
before using it twice: a retried task asks again."""

from __future__ import annotations

import http.client
import json
import logging
import random
import socket
import ssl
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import guard_kind, is_private_ip, split_url
from webloom.operators.threads import mentioned_ids
from webloom.schemas import API_RESPONSE, HTTP_RESPONSE, RESOLVED
from webloom.sources.flight import LookupTimeout, Names, flown, within

# Limits of live requests.
IN_FLIGHT, ATTEMPTS, BASE_BACKOFF_MS = 5, 3, 1000
CONNECT_S, TOTAL_S, DNS_S, MAX_REDIRECTS, MAX_BYTES = 10, 30, 5, 5, 10_000_000
RESEARCH_PAGE_S = 15
#: Bytes of an API's answer that are read at most.
MAX_API_BYTES = 100_000_000
SECRET_HEADERS = ("Authorization", "x-goog-api-key")
AGENT = "webloom/0.1"
log = logging.getLogger(__name__)


def jittered_backoff(attempt: int, rnd: Callable[[], float] = random.random) -> float:
    """Seconds before try attempt+1: half of a doubling base, and up to as much again."""
    base = BASE_BACKOFF_MS * 2**attempt
    return (base / 2 + rnd() * base / 2) / 1000


def retry_with(op: Callable, retriable: Callable, sleep: Callable = time.sleep):
    """op() until its outcome is not retriable, at most three times; the last outcome."""
    for attempt in range(ATTEMPTS):
        out = op()
        if attempt == ATTEMPTS - 1 or not retriable(out):
            return out
        log.warning("try %d failed, trying again", attempt + 1)
        sleep(jittered_backoff(attempt))


def _look_up(host: str, port: int) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(host, port, 0, socket.SOCK_STREAM)})


_names: Names | None = None


def resolve_host(host: str, port: int) -> list[str]:
    """Addresses of a name, by the process's own resolver."""
    global _names
    _names = _names or Names(_look_up, DNS_S)
    return _names(host, port)


def get_page(url: str, resolver=resolve_host, blocked: Callable = is_private_ip, total_s: float = TOTAL_S) -> tuple:
    """(url, final_url, status, content_type, body, failure). Every hop is checked and the checked address is the one
    that is connected to; redirects are followed by hand. All hops and reads together take `total_s` at most."""
    at, until = url, time.monotonic() + total_s

    def left() -> float:
        if (rest := until - time.monotonic()) <= 0:
            raise TimeoutError
        return rest

    try:
        for _ in range(MAX_REDIRECTS + 1):
            if (kind := guard_kind(at)) and not (kind == "InternalHost" and blocked is not is_private_ip):
                return url, at, None, None, None, kind
            scheme, host, is_ip, port, _ = split_url(at)
            addresses = [host] if is_ip else within(lambda: resolver(host, port), min(DNS_S, left()))  # noqa: B023
            if not addresses:
                return url, at, None, None, None, "DnsResolution"
            if any(blocked(a) for a in addresses):
                return url, at, None, None, None, "InternalHost"
            raw = socket.create_connection((addresses[0], port), timeout=min(CONNECT_S, left()))
            raw.settimeout(left())
            connection = http.client.HTTPConnection(host, port)
            connection.sock = sock = ssl.create_default_context().wrap_socket(raw, server_hostname=host) if scheme == "https" else raw
            try:
                parts = urlsplit(at)
                connection.request("GET", (quote(parts.path, safe="/%:@!$&'()*+,;=~-._") or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": AGENT, "Accept": "text/html,*/*"})
                r = connection.getresponse()
                if r.status in (301, 302, 303, 307, 308) and r.getheader("location"):
                    at = urljoin(at, r.getheader("location"))
                    continue
                if int(r.getheader("content-length") or 0) > MAX_BYTES:
                    return url, at, r.status, r.getheader("content-type"), None, "TooLarge"
                body = bytearray()
                while len(body) <= MAX_BYTES:
                    sock.settimeout(left())
                    if not (chunk := r.read1(1 << 16)):
                        break
                    body += chunk
                return url, at, r.status, r.getheader("content-type"), bytes(body), None
            finally:
                connection.close()
        return url, at, None, None, None, "Http"
    except (LookupTimeout, socket.gaierror):
        return url, at, None, None, None, "Timeout" if time.monotonic() >= until else "DnsResolution"
    except TimeoutError:
        return url, at, None, None, None, "Timeout"
    except (OSError, http.client.HTTPException, ValueError):
        return url, at, None, None, None, "Http"


def _size(answer: tuple) -> int:
    return sum(len(x) for x in answer if isinstance(x, (str, bytes)))


def _flown(frames: Iterator[pd.DataFrame], column: str, one: Callable, names: list[str], types: dict[str, str], host_of: Callable = lambda _: None) -> Iterator[pd.DataFrame]:
    """Answers to a column of requests, in frames of bounded bytes."""
    requests = (x for frame in frames for x in frame[column])
    for answers in flown(requests, one, host_of, _size, IN_FLIGHT):
        yield pd.DataFrame(answers, columns=names).astype(types)


def _host(url: str) -> str | None:
    return split_url(url)[1]


def pages(urls: DataFrame, partitions: int = 8, get: Callable = get_page, host_tasks: int = 2) -> DataFrame:
    """Responses (see HTTP_RESPONSE) of the distinct `url`s. A host's addresses are dealt to at most `host_tasks` tasks, each of
    which has two of them in flight, so that no host is asked by the whole cluster at once."""
    names = [x.split()[0] for x in HTTP_RESPONSE.split(", ")]
    host = F.regexp_extract(F.lower("url"), r"\A\s*[a-z][a-z0-9+.-]*:[/\\]*(?:[^/?#\\]*@)?([^/?#\\:]*)", 1)
    spread = urls.select("url").distinct().repartition(partitions, host, F.pmod(F.xxhash64("url"), F.lit(host_tasks)))
    return spread.mapInPandas(lambda frames: _flown(frames, "url", get, names, {"status": "Int32"}, _host), HTTP_RESPONSE)


def resolved(urls: DataFrame, partitions: int = 8, resolver: Callable = resolve_host) -> DataFrame:
    """(host, ip) of the hosts of `url`; a name without an address has no row."""

    def run(frames):
        for frame in frames:
            rows = []
            for url in frame["url"]:
                _, host, is_ip, port, error = split_url(url)
                if host and not is_ip and error is None:
                    try:
                        rows += [(host, ip) for ip in resolver(host, port)]
                    except OSError:
                        continue
            yield pd.DataFrame(rows, columns=["host", "ip"])

    return urls.select("url").distinct().repartition(partitions).mapInPandas(run, RESOLVED).distinct()


def _api(base: str, headers: dict[str, str], timeout: int, body: bytes | None = None) -> Callable[[str], tuple]:
    scheme, host, _, port, error = split_url(base)
    if error or scheme is None:
        raise ValueError(error or "no scheme")
    if scheme != "https" and any(name in headers for name in SECRET_HEADERS):
        raise ValueError("a token or key goes over HTTPS only")

    def once(path: str) -> tuple:
        kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        connection, until = kind(host, port, timeout=timeout), time.monotonic() + timeout
        try:
            connection.request("POST" if body is not None else "GET", urlsplit(base).path.rstrip("/") + path, body=body, headers=headers | {"User-Agent": AGENT})
            r = connection.getresponse()
            left = r.getheader("x-ratelimit-remaining")
            body_ = bytearray()
            while chunk := r.read1(1 << 16):
                body_ += chunk
                if len(body_) > MAX_API_BYTES or time.monotonic() > until:
                    return path, None, None, None
                if connection.sock:
                    connection.sock.settimeout(max(0.01, until - time.monotonic()))
            return path, r.status, int(left) if left and left.isdigit() else None, body_.decode("utf-8", "replace")
        except (OSError, http.client.HTTPException):
            return path, None, None, None
        finally:
            connection.close()

    return once


def _worth_retry(x: tuple) -> bool:
    return x[1] is None or x[1] == 429 or x[1] >= 500 or x[1] == 403 and x[2] == 0


def repo_api(paths: DataFrame, token=None, base: str = "https://api.github.com", partitions: int = 4, once: Callable | None = None) -> DataFrame:
    """Recorded exchanges (path, status, remaining, body) of the distinct `path`s, with retries."""
    headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token.expose()}"} if token else {})
    ask = once or _api(base, headers, TOTAL_S)
    names = [x.split()[0] for x in API_RESPONSE.split(", ")]
    one = lambda path: retry_with(lambda: ask(path), _worth_retry)
    spread = paths.filter("path IS NOT NULL").select("path").distinct().repartition(partitions)
    return spread.mapInPandas(lambda frames: _flown(frames, "path", one, names, {"status": "Int32", "remaining": "Int64"}), API_RESPONSE)


def search_api(queries: DataFrame, key, model: str, base: str = "https://generativelanguage.googleapis.com/v1beta/models", partitions: int = 2, once: Callable | None = None) -> DataFrame:
    """Recorded exchanges (search_query, status, body) of the distinct queries, with retries."""
    secret = key.expose()
    if once is None:
        _api(base, {"x-goog-api-key": secret}, 20)  # a base without HTTPS is refused before anything is sent

    def ask(query: str) -> tuple:
        body = json.dumps({"contents": [{"parts": [{"text": query}]}], "tools": [{"google_search": {}}]}).encode()
        if once:
            return once(query)
        return _api(base, {"Content-Type": "application/json", "x-goog-api-key": secret}, 20, body)(f"/{model}:generateContent")

    def one(query: str) -> tuple:
        found = retry_with(lambda: ask(query), _worth_retry)
        return query, found[1], found[3]

    def run(frames):
        return _flown(frames, "search_query", one, ["search_query", "status", "body"], {"status": "Int32"})

    return queries.select("search_query").distinct().repartition(partitions).mapInPandas(run, "search_query string, status int, body string")


def chat_api(calls: DataFrame, token, base: str = "https://slack.com/api", partitions: int = 2, once: Callable | None = None) -> DataFrame:
    """Recorded bodies (path, body, api_error) of chat methods with their parameters, such as
    '/users.info?user=U1'; no retries. api_error is what the envelope says, null where it is ok."""
    ask = once or _api(base, {"Authorization": f"Bearer {token.expose()}"}, TOTAL_S)
    names = [x.split()[0] for x in API_RESPONSE.split(", ")]
    found = calls.select("path").distinct().repartition(partitions).mapInPandas(lambda frames: _flown(frames, "path", ask, names, {"status": "Int32", "remaining": "Int64"}), API_RESPONSE)
    ok = F.get_json_object("body", "$.ok") == "true"
    return found.select("path", "body", F.when(~F.coalesce(ok, F.lit(False)), F.coalesce(F.get_json_object("body", "$.error"), F.lit("unknown"))).alias("api_error"))


def chat_tables(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, users, channels) from chat_api's rows of history, replies, user and channel calls."""
    param = lambda name: F.try_url_decode(F.regexp_extract("path", rf"[?&]{name}=([^&]*)", 1))
    ok = calls.filter("api_error IS NULL")
    body = F.from_json("body", "messages array<struct<user:string,text:string,ts:string,reply_count:long>>")
    said = ok.filter(F.col("path").rlike(r"^/conversations\.(replies|history)")).withColumn("_thread", F.when(F.contains("path", F.lit("replies")), param("ts")))
    messages = said.select(param("channel").alias("channel"), "_thread", F.explode(body["messages"]).alias("m")).select("channel", "m.ts", F.col("_thread").alias("thread_ts"), "m.user", F.coalesce("m.text", F.lit("")).alias("text"), "m.reply_count")
    user = F.from_json("body", "user struct<real_name:string,profile:struct<display_name:string>>")["user"]
    users = ok.filter(F.startswith("path", F.lit("/users.info"))).select(param("user").alias("user"), user["real_name"].alias("real_name"), user["profile"]["display_name"].alias("display_name"))
    channels = ok.filter(F.startswith("path", F.lit("/conversations.info"))).select(param("channel").alias("channel"), F.get_json_object("body", "$.channel.name").alias("name"))
    return messages, users, channels


def chat_calls(links: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """The chat calls that links (key, link) need, as far as `said` (see chat_api) tells: first the linked thread or
    message and the channel; then the replies of a message that has some; then every author and mentioned user."""
    channel, ts, thread = (F.url_encode(F.col(f"link.{c}")) for c in ("channel", "ts", "thread_ts"))
    replies = lambda c, root: F.concat(F.lit("/conversations.replies?channel="), c, F.lit("&ts="), root)
    first = F.when(thread.isNotNull(), replies(channel, thread)).otherwise(F.concat(F.lit("/conversations.history?channel="), channel, F.lit("&latest="), ts, F.lit("&inclusive=true&limit=1")))
    calls = links.select(F.explode(F.array(first, F.concat(F.lit("/conversations.info?channel="), channel))).alias("path"))
    if said is not None:
        messages, _, _ = chat_tables(said)
        more = messages.filter("thread_ts IS NULL AND reply_count > 0").select(replies(F.url_encode("channel"), F.url_encode("ts")).alias("path"))
        ids = messages.select(F.explode(F.array_union(F.array_compact(F.array("user")), mentioned_ids(F.col("text")))).alias("user"))
        calls = calls.unionByName(more).unionByName(ids.select(F.concat(F.lit("/users.info?user="), F.url_encode("user")).alias("path")))
    return calls.distinct()


def complete(wanted: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame], empty: DataFrame, rounds: int = 3) -> DataFrame:
    """Exchanges for all that `wanted` names, asked for in rounds, since answers name further calls. Each round's answers
    are kept, so that nothing is asked twice."""
    known = empty
    for _ in range(rounds):
        new = wanted(known).join(known.select("path"), "path", "left_anti").persist()
        if not new.limit(1).count():
            break
        known = known.unionByName(ask(new).persist())
    return known
