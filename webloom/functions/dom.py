"""A page as a tree, built in time linear in the page: what an end tag or an implied end closes is looked up by name and
scope, never searched for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link script style base noscript template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What no end tag of another kind reaches across.
SCOPES = ("td", "th", "caption", "table", "#root")
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: A start tag ends the last open element of these names, unless one of those behind was opened since.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", *SCOPES)),
    "dt": (("dt", "dd"), ("dl", *SCOPES)),
    "dd": (("dt", "dd"), ("dl", *SCOPES)),
    "td": (("td", "th"), ("table", "#root")),
    "th": (("td", "th"), ("table", "#root")),
    "tr": (("tr", "td", "th"), ("table", "#root")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table", "#root")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table", "#root")),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table", "#root")),
    "option": (("option",), ("select", *SCOPES)),
    "a": (("a",), SCOPES),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"


#: Elements whose content is no markup; references in the last two are read.
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")


def events(html: str) -> Iterator[tuple]:
    """("start", name, attributes, closed at once), ("end", name) and ("text", text) in order, each character read once. What
    is open at the end (a tag, a comment) is left out, as the web standard has it."""
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            yield "text", unescape(html[at:lt])
        if lt == end:
            return
        follows = html[lt + 1 : lt + 2]
        if follows.isascii() and follows.isalpha():
            m = _NAME.match(html, lt + 1)
            name, attrs, at, closed = m.group().lower(), {}, m.end(), False
            while True:
                gap = _GAP.match(html, at).end()
                closed, at = gap > at and html[gap - 1] == "/", gap
                if at >= end:
                    return
                if html[at] == ">":
                    break
                m = _ATTRIBUTE.match(html, at)
                key, at, value = m.group().lower(), m.end(), ""
                if (m := _EQUALS.match(html, at)) and m.end() < end:
                    at = m.end()
                    if html[at] in "\"'":
                        close = html.find(html[at], at + 1)
                        if close < 0:
                            return
                        value, at = html[at + 1 : close], close + 1
                    else:
                        m = _BARE.match(html, at)
                        value, at = m.group(), m.end()
                attrs.setdefault(key, unescape(value))
            at += 1
            yield "start", name, attrs, closed
            if name in RAW:
                found = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                stop = found.start() if found else end
                if stop > at:
                    yield "text", unescape(html[at:stop]) if name in RAW[-2:] else html[at:stop]
                at = stop
        elif follows == "/" and (m := _NAME.match(html, lt + 2)):
            close = html.find(">", m.end())
            if close < 0:
                return
            yield "end", m.group().lower()
            at = close + 1
        elif html.startswith("<!--", lt):
            early = re.compile("-?>").match(html, lt + 4)
            close = early.start() if early else html.find("-->", lt + 4)
            if close < 0:
                return
            at = html.find(">", close) + 1
        elif follows in ("!", "?", "/"):
            close = html.find(">", lt + 2)
            if close < 0:
                return
            at = close + 1
        else:
            yield "text", "<"
            at = lt + 1


class _Builder:
    def __init__(self):
        self.root = Node("#root", {}, None)
        self.stack, self.open, self.blocks = [self.root], {"#root": [0]}, [0]

    def last(self, names) -> int:
        """The place on the stack of the last open element of one of the names, or -1."""
        return max((at[-1] for n in names if (at := self.open.get(n))), default=-1)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            node = self.stack.pop()
            self.open[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag not in HEAD and (head := self.open.get("head")):
            self.cut(head[-1])
        if tag in BLOCKS and tag not in ("html", "body"):
            p = self.last(("p",))
            if p > self.last(SCOPES):
                self.cut(p)
        if tag in IMPLIED:
            closed, within = IMPLIED[tag]
            bound = self.last(within)
            first = min((at[-1] for n in closed if (at := self.open.get(n)) and at[-1] > bound), default=-1)
            if first > 0:
                self.cut(first)
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID and not (closed and (self.open.get("svg") or self.open.get("math"))):
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCKS:
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        if at < 1 or tag in ("html", "body"):
            return
        if tag not in TABLE_PARTS and at < self.last(SCOPES):
            return  # opened outside this cell
        if tag not in BLOCKS and at < self.blocks[-1]:
            return  # a mark that was opened outside this block ends with what holds it
        if tag in TABLE_PARTS and tag != "table" and at < self.last(("table",)):
            return
        self.cut(at)

    def text(self, data: str) -> None:
        if (head := self.open.get("head")) and head[-1] == len(self.stack) - 1 and data.strip():
            self.cut(head[-1])
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    for kind, *what in events(html):
        getattr(builder, kind)(*what)
    return builder.root


def nodes(root: Node) -> list[Node]:
    """All elements in document order; backwards, every element comes before those that hold it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def text(root: Node, without: frozenset[str] = frozenset()) -> str:
    out, todo = [], [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif at.tag not in without:
            todo.extend(reversed(at.children))
    return "".join(out)


def serialized(roots: list[Node], without: frozenset[str] = frozenset()) -> str:
    out, todo = [], list(reversed(roots))
    while todo:
        at = todo.pop()
        if isinstance(at, tuple):
            out.append(at[0])
        elif isinstance(at, str):
            out.append(escape(at, quote=False))
        elif at.tag == "#root":
            todo.extend(reversed(at.children))
        elif at.tag not in without:
            out.append(f"<{at.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in at.attrs.items()) + ">")
            if at.tag not in VOID:
                todo.append((f"</{at.tag}>",))
                todo.extend(reversed(at.children))
    return "".join(out)
