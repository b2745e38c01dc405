"""HTML trees as Markdown in one pass over the open elements: headings, emphasis, links, images, nested lists, quotes, rules,
code and pipe tables. Every text of the page comes out once, but for what is never shown."""

from __future__ import annotations

import re

from webloom.functions.dom import BLOCKS, Node, nodes, text

HIDDEN = frozenset("script style noscript template iframe svg math head title object canvas audio video".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "tt": "`", "kbd": "`", "samp": "`"}
#: Levels up to which lists and quotes are indented; deeper ones stand at that level, so that output stays linear.
MAX_LEVEL = 40
_BROKEN = BLOCKS | frozenset("hr option button textarea legend".split())
_HEADINGS, _LISTS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu")
_STRUCTURE = frozenset("table ul ol pre blockquote h1 h2 h3 h4 h5 h6 hr dl figure".split())


def layout_tables(root: Node) -> set[int]:
    """Tables that cannot be rows of cells, by identity: those that hold structure, several paragraphs in a cell or one column."""
    rich: dict[int, bool] = {}
    out = set()
    for node in reversed(nodes(root)):
        inside = [c for c in node.children if not isinstance(c, str)]
        below = any(rich[id(c)] or c.tag in _STRUCTURE for c in inside)
        if node.tag in ("td", "th"):
            below = below or sum(c.tag in ("p", "div") for c in inside) > 1
        rich[id(node)] = below
        if node.tag == "table" and (below or not _has_columns(node)):
            out.add(id(node))
    return out


def _has_columns(table: Node) -> bool:
    parts = [r for c in table.children if not isinstance(c, str) for r in ([c] if c.tag == "tr" else c.children) if not isinstance(r, str) and r.tag == "tr"]
    return any(sum(not isinstance(c, str) and c.tag in ("td", "th") for c in r.children) > 1 for r in parts)


def _listed(node: Node) -> bool:
    """A list that stands in another without an item around it."""
    return node.parent is not None and node.parent.tag in _LISTS


class _Writer:
    def __init__(self, layout: set[int]):
        self.layout = layout
        self.out: list[str] = []
        self.inline: list[str] = []
        self.frames: list[list] = []  # open marks: [mark or link, place in inline]
        self.prefixes: list[list] = []  # open quotes and items: [first line's, other lines', used]
        self.deeper = 0  # those beyond the last level
        self.lists: list[list] = []  # open lists: [kind, next number]
        self.in_list = False  # the last block was in the list that is still open
        self.heading = 0
        self.table: list | None = None  # rows of the open pipe table
        self.between: list[str] = []  # what stands in it outside cells

    # inline text

    def mark(self, mark) -> None:
        self.frames.append([mark, len(self.inline)])

    def close(self) -> None:
        mark, at = self.frames.pop()
        body = re.sub(r"[^\S\n]+", " ", "".join(self.inline[at:]))
        del self.inline[at:]
        if not body.strip():
            self.inline.append(body)
            return
        head, inner, tail = body[: len(body) - len(body.lstrip())], body.strip(), body[len(body.rstrip()) :]
        if isinstance(mark, tuple):
            inner = f"[{re.sub(r'\s+', ' ', inner)}]({mark[0]})"
        elif mark == "`":
            fence = "`" * (1 + max((len(x) for x in re.findall("`+", inner)), default=0))
            inner = f"{fence} {inner} {fence}" if len(fence) > 1 else f"`{inner}`"
        else:
            inner = mark + inner + mark
        self.inline.append(head + inner + tail)

    def taken(self) -> str:
        """The text so far, its marks closed here and opened again behind."""
        marks = [m for m, _ in self.frames]
        while self.frames:
            self.close()
        body = "".join(self.inline)
        self.inline.clear()
        for m in marks:
            self.mark(m)
        return body

    # blocks

    def flush(self) -> None:
        body = re.sub(r"[^\S\n]*\n[^\S\n]*", "\n", re.sub(r"[^\S\n]+", " ", self.taken())).strip()
        if body:
            lines = body.split("\n")
            self.block(["#" * self.heading + " " + " ".join(lines)] if self.heading else lines)

    def block(self, lines: list[str]) -> None:
        fresh = any(not p[2] for p in self.prefixes if p[0] != p[1])
        if self.out and not (fresh and self.in_list):
            self.out.append("".join(p[1] for p in self.prefixes if p[2]).rstrip())
        for line in lines:
            self.out.append(("".join(p[1] if p[2] else p[0] for p in self.prefixes) + line).rstrip() if line else "".join(p[1] for p in self.prefixes).rstrip())
            for p in self.prefixes:
                p[2] = True
        self.in_list = bool(self.lists and self.prefixes)

    def enter(self, node: Node) -> bool:
        """Whether the element opened a mark, which its end must close."""
        tag = node.tag
        if tag in MARKS or tag == "a" and node.attrs.get("href"):
            mark = MARKS.get(tag) or (node.attrs["href"],)
            held = [m for m, _ in self.frames]
            if mark in held or "`" in held or tag == "a" and any(isinstance(m, tuple) for m in held):
                return False  # marks do not nest in themselves, links not in links
            self.mark(mark)
            return True
        if tag == "img":
            if node.attrs.get("src"):
                self.inline.append(f"![{re.sub(r'\s+', ' ', node.attrs.get('alt', ''))}]({node.attrs['src']})")
        elif tag == "br":
            self.inline.append(" " if self.table is not None or self.heading else "\n")
        elif self.table is not None:
            if tag == "tr":
                self.table.append([])
            elif tag in ("td", "th"):
                self.stray()
            elif tag in _BROKEN:
                self.inline.append(" ")
        elif tag in _BROKEN:
            self.flush()
            if tag == "hr":
                self.block(["---"])
            elif tag == "table" and id(node) not in self.layout:
                self.table, self.between = [], []
            elif tag in _HEADINGS:
                self.heading = int(tag[1])
            elif tag in _LISTS:
                if not self.lists:
                    self.in_list = False
                start = node.attrs.get("start", "")
                if _listed(node):
                    self.prefix("   ", "   ")
                self.lists.append(["ol" if tag == "ol" else "ul", int(start) if re.fullmatch("[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = self.lists[-1] if self.lists else ["ul", 1]
                first = "- " if kind[0] == "ul" else f"{kind[1]}. "
                kind[1] += 1
                self.prefix(first, " " * len(first))
            elif tag == "blockquote":
                self.prefix("> ", "> ")
        return False

    def prefix(self, first: str, rest: str) -> None:
        if len(self.prefixes) < MAX_LEVEL:
            self.prefixes.append([first, rest, not first.strip()])
        else:
            self.deeper += 1

    def unprefix(self) -> None:
        if self.deeper:
            self.deeper -= 1
        else:
            self.prefixes.pop()

    def leave(self, node: Node, marked: bool) -> None:
        tag = node.tag
        if marked:
            self.close()
        elif self.table is not None:
            if tag in ("td", "th"):
                if not self.table:
                    self.table.append([])
                self.table[-1].append(re.sub(r"\s+", " ", self.taken()).strip().replace("|", "\\|"))
            elif tag == "table":
                self.rows()
            elif tag in _BROKEN:
                self.inline.append(" ")
        elif tag in _BROKEN:
            self.flush()
            if tag in _HEADINGS:
                self.heading = 0
            elif tag in _LISTS:
                self.lists.pop()
                if _listed(node):
                    self.unprefix()
            elif tag in ("li", "blockquote"):
                self.unprefix()

    def stray(self) -> None:
        if body := re.sub(r"\s+", " ", self.taken()).strip():
            self.between.append(body)

    def rows(self) -> None:
        self.stray()
        rows, self.table = [r for r in self.table if r], None
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.block([lines[0], "|" + " --- |" * width, *lines[1:]])
        for body in self.between:
            self.block([body])

    def code(self, node: Node) -> None:
        self.flush()
        body = text(node, HIDDEN).strip("\n")
        if not body.strip():
            return
        named = node.names() + " " + " ".join(c.names() for c in node.children if not isinstance(c, str))
        language = re.search(r"\blanguage-([\w+#-]+)", named)
        fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", body)), default=0))
        self.block([fence + (language[1] if language else ""), *body.split("\n"), fence])


def render(roots: list[Node]) -> str:
    """The Markdown of some trees, one behind the other; empty or ended by a line end."""
    layout = set()
    for root in roots:
        layout |= layout_tables(root)
    writer = _Writer(layout)
    for root in roots:
        todo: list = [root]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                writer.inline.append(re.sub(r"\s+", " ", at))
            elif isinstance(at, tuple):
                writer.leave(*at)
            elif at.tag == "pre" and writer.table is None:
                writer.code(at)
            elif at.tag not in HIDDEN:
                todo.append((at, writer.enter(at)))
                todo.extend(reversed(at.children))
        writer.flush()
    out = "\n".join(writer.out)
    return out + "\n" if out else ""
