import threading
import time

import pytest

from webloom.functions import codec, hosts
from webloom.functions.urls import guard_kind, split_url
from webloom.sources import flight, live


@pytest.mark.parametrize(
    ("host", "want"),
    [
        ("faß.de", "xn--fa-hia.de"), ("FAẞ.de", "xn--fa-hia.de"), ("Bücher.example", "xn--bcher-kva.example"), ("ＥＸＡＭＰＬＥ．com", "example.com"), ("a­b.c", "ab.c"), ("☃.net", "xn--n3h.net"), ("σς.gr", "xn--3xab.gr"), ("a。b｡c", "a.b.c"),
        ("xn--bcher-kva.de", "xn--bcher-kva.de"), ("مثال.إختبار", "xn--mgbh0fb.xn--kgbechtv"), ("a..b", "a..b"), ("a_b.c", "a_b.c"),
    ],
)
def test_hosts(host, want):
    assert hosts.ascii_host(host) == want


@pytest.mark.parametrize("host", ["xn--a", "xn--", "́a.b", "a‍b", "a b", "a�.b", "xn--a-ecp.ru͸", "", "a%b", "אa"])
def test_no_hosts(host):
    with pytest.raises(ValueError):
        hosts.ascii_host(host)


@pytest.mark.parametrize(("url", "kind"), [("http://1.2.3.4.5/", "InvalidUrl"), ("http://foo.09/", "InvalidUrl"), ("http://foo.0x1/", "InvalidUrl"), ("http://1.2.3.4./", None), ("http://①②⑦.0.0.1", "InternalHost"), ("http://0x7f000001", "InternalHost"), ("http://256.1.1.1", "InvalidUrl"), ("http://1_0.1.1.1", "InvalidUrl"), ("http://4294967296", "InvalidUrl"), ("http://08.1.1.1", "InvalidUrl"), ("http://a.1b/", None)])
def test_numbers(url, kind):
    assert guard_kind(url) == kind


def test_faß_is_another_host_than_fass():
    assert split_url("http://faß.de/")[1] != split_url("http://fass.de/")[1]


def test_all_bytes():
    every = bytes(range(256))
    latin = codec.decode(every, "latin1")
    assert [ord(latin[b]) for b in (0x80, 0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xE9)] == [0x20AC, 0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xE9] and len(latin) == 256
    assert codec.decode(every, "windows-1253")[0xAA] == "�" and codec.decode(every, "windows-1255")[0xD9] == "�" and codec.decode(every, "windows-874")[0xDB] == "�"
    assert codec.decode(b"\xae\xbe", "koi8-u") == "ўЎ"
    assert codec.decode(every, "x-user-defined") == "".join(chr(b if b < 128 else 0xF700 + b) for b in range(256))
    for label in ("iso-8859-2", "koi8-r", "ibm866", "macintosh", "x-mac-cyrillic", "iso-8859-16", "windows-1258"):
        assert codec.decode(every, label)[:128] == every[:128].decode("ascii")


def test_marks():
    assert codec.decode(b"\xef\xbb\xbfa\xc3\xa9", "latin1") == "aé"
    assert codec.decode(b"\xff\xfea\x00", "shift_jis") == "a" and codec.decode(b"\xfe\xff\x00a", "utf-16le") == "a"
    assert codec.decode(b"\xef\xbb\xbfa", None) == "﻿a" and codec.decode(b"\xef\xbb\xbfa", "unknown") == "﻿a"
    assert codec.decode(b"xx", "ISO-2022-KR ") == "�" and codec.decode(b"", "hz-gb-2312") == ""


def test_hosts_share_the_flight():
    """Of two hosts, one with many slow requests: neither is asked more than twice at a time, the other one is not held up."""
    now, most, order, guard = {}, {}, [], threading.Lock()

    def one(request):
        host = request[0]
        with guard:
            now[host] = now.get(host, 0) + 1
            most[host] = max(most.get(host, 0), now[host])
        time.sleep(0.05 if host == "slow" else 0.001)
        with guard:
            now[host] -= 1
            order.append(request)
        return request

    asked = [("slow", i) for i in range(20)] + [("quick", i) for i in range(20)] + [(None, 0)]
    got = [x for part in flight.flown(asked, one, lambda r: r[0]) for x in part]
    assert sorted(got, key=str) == sorted(asked, key=str) and most["slow"] <= 2 and most["quick"] <= 2
    assert order.index(("quick", 19)) < order.index(("slow", 12))


def test_answers_leave_by_bytes_and_requests_are_read_as_needed():
    read = []

    def asked():
        for i in range(3000):
            read.append(i)
            yield i

    parts = flight.flown(asked(), lambda i: b"x" * 8_000_000 if i < 40 else b"", size_of=len)
    first = next(parts)
    assert sum(map(len, first)) <= flight.HELD_BYTES + 8_000_000 * flight.IN_FLIGHT and len(read) <= flight.WAITING + flight.HELD_ROWS
    assert len(first) + sum(map(len, parts)) == 3000
    assert list(flight.flown([], lambda i: i)) == []
    with pytest.raises(KeyError):
        list(flight.flown([1, 2], lambda i: {}[i]))


def test_a_hanging_lookup_is_left_behind():
    def hangs(host, port):
        time.sleep(30)

    start = time.monotonic()
    names = flight.Names(hangs, 0.3)
    for _ in range(3):  # asked once, the failure is kept
        with pytest.raises(flight.LookupTimeout):
            names("a.example", 80)
    assert time.monotonic() - start < 1.5
    start = time.monotonic()
    found = live.get_page("http://name.example/", resolver=hangs, total_s=0.4)
    assert time.monotonic() - start < 2 and found[5] in ("DnsResolution", "Timeout")


def test_names_are_asked_once():
    asked = []

    def lookup(host, port):
        asked.append(host)
        time.sleep(0.05)
        if host == "none":
            raise OSError("no such name")
        return ["9.9.9.9"]

    names = flight.Names(lookup, 5)
    threads = [threading.Thread(target=names, args=("a", 80)) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert names("a", 80) == ["9.9.9.9"] and asked == ["a"]
    for _ in range(2):
        with pytest.raises(OSError, match="no such name"):
            names("none", 80)
    assert asked == ["a", "none"]
