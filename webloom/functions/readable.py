"""The main article of a page by the usual readability signals: candidates scored by the paragraphs below them, siblings joined,
lists of links and the like cleaned away, and all of it again with relaxed rules where that leaves little text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from webloom.functions.dom import Node, nodes, parse, serialized, text

# Thresholds of the usual readability rules.
READABLE_SCORE, READABLE_CHARS, PARAGRAPH_CHARS, ENOUGH_CHARS = 20, 140, 25, 500
NEVER = frozenset("script style noscript template iframe svg math object embed canvas head title link meta".split())
CONTROLS = frozenset("input select textarea button".split())
CHROME = frozenset("nav footer aside".split())
_UNLIKELY = re.compile(r"\b(?:comments?|sidebar|side-bar|footer|foot|menu|nav(?:bar|igation)?|breadcrumbs?|share|sharing|social|advert(?:isement|ising)?|ads?|promo(?:tion)?|cookies?|banner|related|sponsor(?:ed)?|newsletter|pagination|pager|popup|modal|login|widget)\b", re.I)
_MAYBE = re.compile(r"article|body|content|main|column|post|entry|story|text", re.I)
_GOOD = re.compile(r"\b(?:article|body|content|entry|main|page|post|text|blog|story)\b", re.I)
_BAD = re.compile(r"\b(?:hidden|banner|comments?|contact|foot|footer|masthead|meta|promo|related|share|shopping|sidebar|sponsor|tags|widget)\b", re.I)
_TAG_SCORE = {"article": 10, "main": 8, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_HOLDS_BLOCKS = frozenset("article aside blockquote div dl figure footer form header main nav ol p pre section table ul".split())
#: Attempts in order: without unlikely elements, by class names, cleaned; each time one rule less.
LADDER = ((True, True, True), (False, True, True), (False, False, True), (False, False, False))


@dataclass
class Measure:
    """A subtree's characters without blanks at the ends of texts, those in links, commas, and counts of elements."""

    chars: int = 0
    linked: int = 0
    commas: int = 0
    paragraphs: int = 0
    images: int = 0
    controls: int = 0
    items: int = 0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def measured(order: list[Node], out: set[int]) -> dict[int, Measure]:
    """By identity, what each element holds; each is looked at once. Elements in `out` hold nothing."""
    found: dict[int, Measure] = {}
    for node in reversed(order):
        m = found[id(node)] = Measure()
        if node.tag in NEVER or id(node) in out:
            continue
        for c in node.children:
            if isinstance(c, str):
                m.chars += len(c.strip())
                m.commas += c.count(",") + c.count("，") + c.count("、")
            else:
                x = found[id(c)]
                m.chars, m.linked, m.commas = m.chars + x.chars, m.linked + x.linked, m.commas + x.commas
                m.paragraphs, m.images, m.controls, m.items = m.paragraphs + x.paragraphs + (c.tag == "p"), m.images + x.images + (c.tag == "img"), m.controls + x.controls + (c.tag in CONTROLS), m.items + x.items + (c.tag == "li")
        if node.tag == "a":
            m.linked = m.chars
    return found


def readable(order: list[Node], of: dict[int, Measure]) -> bool:
    """Whether paragraphs and articles hold enough text, each of more than 140 characters adding the root of what is beyond."""
    total = 0.0
    for node in order:
        if node.tag in ("p", "pre", "article") or node.tag == "div" and any(not isinstance(c, str) and c.tag == "br" for c in node.children):
            if not unlikely(node) and node.parent is not None and not (node.tag == "p" and node.parent.tag == "li"):
                total += max(0, of[id(node)].chars - READABLE_CHARS) ** 0.5
                if total > READABLE_SCORE:
                    return True
    return False


def unlikely(node: Node) -> bool:
    names = node.names()
    return bool(_UNLIKELY.search(names)) and not _MAYBE.search(names)


def weight(node: Node) -> int:
    return sum(25 * bool(_GOOD.search(x)) - 25 * bool(_BAD.search(x)) for x in (node.attrs.get("class", ""), node.attrs.get("id", "")) if x)


def dropped(order: list[Node], strip: bool) -> set[int]:
    """Elements that are no part of an article whatever the scores say."""
    out = set()
    for node in order:
        if node.tag in NEVER or node.tag in CHROME or node.attrs.get("hidden") is not None and "hidden" in node.attrs or "display:none" in node.attrs.get("style", "").replace(" ", ""):
            out.add(id(node))
        elif strip and node.tag not in ("#root", "html", "body", "a", "article", "main") and unlikely(node):
            out.add(id(node))
    return out


def attempt(root: Node, strip: bool, weigh: bool, clean: bool) -> tuple[int, list[Node], set[int]]:
    """(characters, the elements of the article in order, what is left out of them) by one set of rules."""
    order = nodes(root)
    gone = dropped(order, strip)
    of = measured(order, gone)
    score: dict[int, float] = {}
    held: dict[int, Node] = {}
    within = set()  # below what is gone
    for node in order:
        if id(node) in gone or id(node.parent) in within:
            within.add(id(node))
    for node in order:
        if id(node) in within:
            continue
        leaf = node.tag in ("p", "td", "pre", "blockquote") or node.tag in ("div", "section", "article", "main") and not any(not isinstance(c, str) and c.tag in _HOLDS_BLOCKS for c in node.children)
        m = of[id(node)]
        if not leaf or m.chars < PARAGRAPH_CHARS:
            continue
        points, up, level = 1 + m.commas + min(m.chars // 100, 3), node.parent, 0
        if node.tag not in ("p", "td", "pre", "blockquote"):  # a division of text only is a paragraph and its own parent
            up, level = node, 0
        while up is not None and up.tag != "#root" and level < 5:
            if id(up) not in score:
                score[id(up)], held[id(up)] = _TAG_SCORE.get(up.tag, 0) + (weight(up) if weigh else 0), up
            score[id(up)] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for i in score:
        score[i] *= 1 - of[i].density()
    ranked = sorted(score, key=lambda i: -score[i])
    if not ranked:
        body = next((n for n in order if n.tag == "body"), root)
        return of[id(body)].chars, [body], gone
    top = held[ranked[0]]
    # a common ancestor of several candidates that are nearly as good
    lines = []
    for i in ranked[1:5]:
        if score[i] >= 0.75 * score[ranked[0]]:
            up, line = held[i].parent, set()
            while up is not None:
                line.add(id(up))
                up = up.parent
            lines.append(line)
    if len(lines) >= 3:
        up = top.parent
        while up is not None and up.tag not in ("body", "html", "#root"):
            if sum(id(up) in line for line in lines) >= 3:
                top = up
                break
            up = up.parent
    # parents that score better still, and parents of an only child
    best, up = score.get(id(top), 0.0), top.parent
    while up is not None and up.tag not in ("body", "html", "#root"):
        if id(up) in score and score[id(up)] > best:
            top, best = up, score[id(up)]
        elif id(up) in score and score[id(up)] < best / 3:
            break
        up = up.parent
    while top.parent is not None and top.parent.tag not in ("body", "html", "#root") and sum(not isinstance(c, str) or bool(c.strip()) for c in top.parent.children) == 1:
        top = top.parent
    chosen, limit = [], max(10.0, 0.2 * score.get(id(top), 0.0))
    siblings = [c for c in top.parent.children if not isinstance(c, str)] if top.parent is not None and top.tag not in ("body", "html") else [top]
    for c in siblings:
        if id(c) in within:
            continue
        m = of[id(c)]
        bonus = 0.2 * score.get(id(top), 0.0) if c.attrs.get("class") and c.attrs.get("class") == top.attrs.get("class") else 0.0
        prose = c.tag == "p" and (m.chars > 80 and m.density() < 0.25 or 0 < m.chars <= 80 and not m.linked and re.search(r"[.!?。](?:\s|$)", text(c)))
        if c is top or score.get(id(c), 0.0) + bonus >= limit and (id(c) in score) or prose:
            chosen.append(c)
    if clean:
        tops = {id(c) for c in chosen}
        for node in (n for c in chosen for n in nodes(c)):
            if id(node) not in tops and id(node) not in within and cluttered(node, of[id(node)], weigh):
                gone.add(id(node))
    left = measured([n for c in chosen for n in nodes(c)], gone)
    return sum(left[id(c)].chars for c in chosen), chosen, gone


def cluttered(node: Node, m: Measure, weigh: bool) -> bool:
    """Whether a division, list, table or form holds links or controls rather than text."""
    if node.tag not in ("div", "section", "ul", "ol", "dl", "table", "form", "fieldset", "header") or not m.chars and not m.images:
        return False
    own = weight(node) if weigh else 0
    if own < 0:
        return True
    if m.commas >= 10:
        return False
    density = m.density()
    return m.controls > 2 and m.controls > m.paragraphs / 3 or density > (0.5 if own else 0.4) and (node.tag not in ("ul", "ol", "dl") or m.linked > 0.6 * m.chars) or node.tag == "form" and m.paragraphs == 0 and m.controls > 0


def metadata(order: list[Node]) -> tuple[str | None, str | None]:
    """(byline, published) from meta elements, linked data, or an element that says so."""
    meta: dict[str, str] = {}
    for node in order:
        if node.tag == "meta" and (key := (node.attrs.get("property") or node.attrs.get("name", "")).strip().lower()):
            meta.setdefault(key, node.attrs.get("content", "").strip())
    data: dict = {}
    for node in order:
        if node.tag == "script" and node.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                found = json.loads(text(node))
            except (ValueError, RecursionError):
                continue
            found = found.get("@graph", found) if isinstance(found, dict) else found
            for x in found if isinstance(found, list) else [found]:
                if isinstance(x, dict) and re.search(r"Article|Posting|WebPage|Report", str(x.get("@type"))):
                    data = data or x
    author = data.get("author")
    names = [a.get("name") if isinstance(a, dict) else a for a in (author if isinstance(author, list) else [author])]
    named = ", ".join(a.strip() for a in names if isinstance(a, str) and a.strip())
    byline = named or meta.get("author") or meta.get("article:author") or meta.get("dc.creator") or meta.get("dcterm.creator")
    if not byline:
        marked = (n for n in order if n.attrs.get("rel") == "author" or "author" in n.attrs.get("itemprop", "") or re.search(r"\b(?:byline|author|dateline)\b", n.names(), re.I))
        byline = next((t for n in marked if 0 < len(t := re.sub(r"\s+", " ", text(n)).strip()) < 100), None)
    date = data.get("datePublished")
    published = (date if isinstance(date, str) else None) or meta.get("article:published_time") or meta.get("parsely-pub-date") or meta.get("dcterms.date")
    return byline or None, published or None


def without(root: Node, gone: set[int]) -> None:
    """Take elements out of a tree."""
    for node in nodes(root):
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]


@dataclass
class Article:
    byline: str | None
    published: str | None
    parts: list[Node]

    def html(self) -> str:
        return serialized(self.parts, NEVER)


def article_of(html: str, root: Node | None = None) -> Article | None:
    """The article of a page, its tree pruned to it; None where the page is not readable."""
    root = root or parse(html)
    order = nodes(root)
    if not readable(order, measured(order, set())):
        return None
    byline, published = metadata(order)
    best: tuple[int, list[Node], set[int]] | None = None
    for rules in LADDER:
        found = attempt(root, *rules)
        if best is None or found[0] > best[0]:
            best = found
        if best[0] >= ENOUGH_CHARS:
            break
    size, parts, gone = best
    if not size:
        return None
    for part in parts:
        without(part, gone)
    return Article(byline, published, parts)
