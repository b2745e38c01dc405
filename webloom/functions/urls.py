"""URL, repository and permalink column functions. URL safety needs standards-like parsing, which Spark's
parse_url is not; it runs in Arrow UDFs, meant for distinct URLs."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import arrow_udf
from webloom.functions.hosts import ascii_host, ipv4

# Hosts and networks that are never fetched.
BLOCKED_HOST = "localhost"
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".arpa")
PRIVATE_V4 = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8", "255.255.255.255/32", "100.64.0.0/10")
PRIVATE_V6 = ("::1/128", "::/128", "fe80::/10", "fc00::/7")
_V4 = [ipaddress.ip_network(n) for n in PRIVATE_V4]
_V6 = [ipaddress.ip_network(n) for n in PRIVATE_V6]
DEFAULT_PORT = {"http": 80, "https": 443}

PARTS = "scheme string, host string, is_ip boolean, port int, error string"


def is_private_ip(ip: str) -> bool:
    """Whether an address may not be fetched from; a v4 address mapped into v6 counts as v4."""
    a = ipaddress.ip_address(ip)
    if a.version == 6:
        return is_private_ip(str(a.ipv4_mapped)) if a.ipv4_mapped else any(a in n for n in _V6)
    return any(a in n for n in _V4)


def split_url(raw: str | None) -> tuple:
    """(scheme, host, is_ip, port, error) of a URL, hosts in lower case and numbers as addresses."""
    try:
        text = re.sub(r"[\t\n\r]", "", (raw or "").strip("".join(map(chr, range(33)))))
        m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
        if not m:
            raise ValueError("relative URL without a base")
        scheme = m[1].lower()
        if scheme not in DEFAULT_PORT:
            return scheme, None, False, None, None
        rest = re.sub(r"^[/\\]*", "", text[m.end() :])
        authority = re.split(r"[/\\?#]", rest, maxsplit=1)[0].rpartition("@")[2]
        if authority.startswith("["):
            inside, _, after = authority[1:].partition("]")
            host, port, is_ip = str(ipaddress.IPv6Address(inside)), after.removeprefix(":"), True
        else:
            host, _, port = authority.partition(":")
            host = ascii_host(unquote(host, errors="strict"))
            v4 = ipv4(host)
            host, is_ip = v4 or host, v4 is not None
        if port and (not port.isascii() or not port.isdigit() or int(port) > 65535):
            raise ValueError("invalid port number")
        return scheme, host, is_ip, int(port) if port else DEFAULT_PORT[scheme], None
    except (ValueError, UnicodeError) as e:
        return None, None, False, None, str(e)


@arrow_udf(PARTS)
def _split(urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_url(u) for u in urls], columns=["scheme", "host", "is_ip", "port", "error"]).astype({"port": "Int32"})


def blocked_host(host: str | None, is_ip: bool) -> bool:
    if not host:
        return True
    name = host.removesuffix(".")
    return is_private_ip(host) if is_ip else name == BLOCKED_HOST or name.endswith(BLOCKED_SUFFIXES)


def guard_kind(url: str | None) -> str | None:
    """InvalidUrl, InvalidScheme, InternalHost, or None for a URL that may be fetched as far as it tells itself."""
    scheme, host, is_ip, _, error = split_url(url)
    if error is not None:
        return "InvalidUrl"
    if scheme not in DEFAULT_PORT:
        return "InvalidScheme"
    return "InternalHost" if blocked_host(host, is_ip) else None


@arrow_udf("string")
def _guard(urls: pd.Series) -> pd.Series:
    return pd.Series([guard_kind(u) for u in urls], dtype=object)


@arrow_udf("boolean")
def _private(ips: pd.Series) -> pd.Series:
    return pd.Series([is_private_ip(x) if x is not None else None for x in ips], dtype=object)


def url_parts(url: Column) -> Column:
    return _split(url)


def url_guard(url: Column) -> Column:
    """Kind of error, or null: scheme, host and address literals are checked, names are not resolved."""
    return _guard(url)


def private_ip(ip: Column) -> Column:
    return _private(ip)


def ssrf_check(urls: DataFrame, resolved: DataFrame, url_col: str = "url") -> DataFrame:
    """`urls` with guard_error: url_guard's kind, or for names DnsResolution where `resolved` (host, ip) has no
    address and InternalHost where any address is private. Address literals are not resolved."""
    bad = resolved.groupBy("host").agg(F.max(private_ip(F.col("ip"))).alias("_private")).withColumnRenamed("host", "_host")
    checked = urls.withColumn("_u", url_parts(F.col(url_col))).withColumn("_kind", url_guard(F.col(url_col))).withColumn("_host", F.col("_u.host")).join(bad, "_host", "left")
    named = F.when(F.col("_u.is_ip"), None).when(F.col("_private").isNull(), "DnsResolution").when(F.col("_private"), "InternalHost")
    return checked.select(*urls.columns, F.coalesce("_kind", named).alias("guard_error"))


def redact_url_credentials(url: Column) -> Column:
    """The URL without user and password; one that has none, and text that is no URL, stays. A web address has its authority
    behind any number of slashes of either kind, and then gets two; any other scheme has one behind two slashes only."""
    web = r"\A(?i)[\x00-\x20]*(https?:)[/\\]*[^/?#\\]*@"
    other = r"\A(?!(?i)[\x00-\x20]*https?:)[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*:)//[^/?#]*@"
    return F.regexp_replace(F.regexp_replace(url, web, "$1//"), other, "$1//")


# What a path keeps when it is percent-encoded, next to letters and digits.
PATH_SAFE = "/!\"$'()*,-.:<>\\^_`{|}~"


@arrow_udf("string")
def _encode_path(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else quote(x, safe=PATH_SAFE))


def encode_path(s: Column) -> Column:
    return _encode_path(s)


def parse_repo(s: Column) -> Column:
    """struct(owner, repo) of 'owner/repo' or of a repository's web address; null if the names are not valid."""
    bare = F.regexp_replace(F.regexp_replace(s, r"\Ahttps?://github\.com/", ""), r"/+\z", "")
    parts = F.split(F.regexp_replace(bare, r"\.git\z", ""), "/", -1)
    owner, repo = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(is_valid_name(owner) & is_valid_name(repo), F.struct(owner.alias("owner"), repo.alias("repo")))


def is_valid_name(s: Column) -> Column:
    return F.coalesce(s.rlike(r"\A[A-Za-z0-9._-]+\z") & ~s.isin(".", ".."), F.lit(False))


def validate_ref(ref: Column) -> Column:
    return (ref != "") & ~ref.rlike(r"[\x00\n\r ~^:\\*?\[]") & ~F.contains(ref, F.lit("..")) & ~F.endswith(ref, F.lit(".")) & ~F.endswith(ref, F.lit(".lock"))


def validate_path(path: Column) -> Column:
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~path.rlike(r"[\x00\n\r]") & ~F.exists(F.split(path, "/", -1), lambda x: x == "..")


def parse_permalink(url: Column) -> Column:
    """struct(workspace, channel, ts, thread_ts, raw_url) of a chat message's permanent link, else null."""
    m = r"(?s)\A\s*(?i:https?)://(?:[^/?#]*@)?([^/?#@:]+)\.(?i:slack\.com)(?::\d*)?/archives/([^/?#]*)/p([^/?#]+)(?:\?([^#]*))?(?:#.*)?\z"
    raw = F.regexp_extract(url, m, 3)
    ok = url.rlike(m) & (F.octet_length(raw) > 6)
    ts = F.concat(F.expr("''"), F.substring(raw, F.lit(1), F.char_length(raw) - 6), F.lit("."), F.right(raw, F.lit(6)))
    thread = F.regexp_extract(F.concat(F.lit("&"), F.regexp_extract(url, m, 4)), r"&thread_ts=([^&]*)", 1)
    has = F.concat(F.lit("&"), F.regexp_extract(url, m, 4)).rlike(r"&thread_ts(?:=|&|\z)")
    return F.when(ok, F.struct(F.lower(F.regexp_extract(url, m, 1)).alias("workspace"), F.regexp_extract(url, m, 2).alias("channel"), ts.alias("ts"), F.when(has, F.try_url_decode(thread)).alias("thread_ts"), url.alias("raw_url")))


def glob_regex(pattern: str) -> str:
    """A glob over one path segment (* ? [] [!] {a,b}) as a Java regex; ValueError if it is not well formed."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed character class: {pattern}")
            body = pattern[i:end]
            negated, body = body[:1] in ("!", "^"), body[body[:1] in ("!", "^") :]
            ranges = re.findall(r"(.)-(.)", body, re.S)
            if any(a > b for a, b in ranges):
                raise ValueError(f"invalid range: {pattern}")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise ValueError(f"unopened alternation: {pattern}")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            if c == "\\" and i < len(pattern):
                c, i = pattern[i], i + 1
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) if c.isascii() else c)
    if depth:
        raise ValueError(f"unclosed alternation: {pattern}")
    return r"(?s)\A" + "".join(out) + r"\z"
