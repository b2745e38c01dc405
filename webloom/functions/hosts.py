"""Host names by the web standard: compatibility mapping that keeps what used to be folded away (ß stays ß), labels in
Punycode, numbers as IPv4 addresses or failures."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

# What mapping ignores, the full stops that separate labels, and characters that keep their meaning.
IGNORED = frozenset("\u00ad\u034f\u180b\u180c\u180d\u180f\u200b\u2060\u2064\ufeff") | {chr(c) for c in range(0xFE00, 0xFE10)}
STOPS = re.compile("[\u3002\uff0e\uff61]")
KEPT = frozenset("\u00df\u03c2\u200c\u200d")
SHARP_S, CAPITAL_SHARP_S = "\u00df", "\u1e9e"
FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_DISALLOWED = frozenset(("Cc", "Cn", "Co", "Cs", "Zl", "Zp", "Zs"))
_VIRAMA = 9


def mapped(host: str) -> str:
    out = []
    for c in STOPS.sub(".", host):
        if c in KEPT:
            out.append(c)
        elif c == CAPITAL_SHARP_S:
            out.append(SHARP_S)
        elif c not in IGNORED:
            out.append(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()))
    return STOPS.sub(".", unicodedata.normalize("NFC", "".join(out)))


def checked(label: str) -> str:
    """The label, or ValueError if it holds what no label may."""
    if unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0])[0] == "M":
        raise ValueError("invalid label")
    for i, c in enumerate(label):
        if unicodedata.category(c) in _DISALLOWED or "\ufff9" <= c <= "\ufffd" or c != mapped(c) and c not in KEPT:
            raise ValueError("disallowed character")
        if c in "\u200c\u200d" and not (i and unicodedata.combining(label[i - 1]) == _VIRAMA):
            raise ValueError("disallowed joiner")
    sides = [unicodedata.bidirectional(c) for c in label]
    if any(s in ("R", "AL", "AN") for s in sides):
        bare = [s for s in sides if s != "NSM"]
        if sides[0] not in ("R", "AL") or "L" in sides or not bare or bare[-1] not in ("R", "AL", "EN", "AN") or "EN" in sides and "AN" in sides:
            raise ValueError("mixed directions")
    return label


def ascii_host(host: str) -> str:
    """The host in ASCII; ValueError for what is no host."""
    labels = []
    for label in mapped(host).split("."):
        if label.startswith("xn--"):
            try:
                inner = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                raise ValueError("invalid Punycode") from None
            if not inner or inner.isascii():
                raise ValueError("invalid Punycode")
            checked(inner)
        elif not label.isascii():
            label = "xn--" + checked(label).encode("punycode").decode()
        labels.append(label)
    out = ".".join(labels)
    if not out or FORBIDDEN.search(out):
        raise ValueError("invalid domain character" if out else "empty host")
    return out


def _number(part: str) -> int:
    if re.fullmatch("0[xX][0-9a-fA-F]*", part):
        return int(part[2:] or "0", 16)
    if re.fullmatch("0[0-7]+", part):
        return int(part, 8)
    if re.fullmatch("0|[1-9][0-9]*", part) and len(part) < 40:
        return int(part)
    raise ValueError("invalid IPv4 address")


def ipv4(host: str) -> str | None:
    """The address that a host stands for whose last label is a number, in up to four decimal, octal or hexadecimal parts; a
    host that ends in a number and is no address is a failure, any other host has none."""
    parts = host.removesuffix(".").split(".")
    if not re.fullmatch("[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return None
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        raise ValueError("invalid IPv4 address")
    return str(ipaddress.IPv4Address(numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))))
