"""Personal data by a semi-Markov conditional random field.

Base spans come by pattern and always stay. What patterns miss (numbers that run into each other, telephone numbers without
a plus sign, spelt-out addresses) is left to the field: in every run of characters that may hold an entity, candidate segments
are scored as a whole, by the number of their digits, how these are grouped, check digit, parts, last label and surroundings, and a
dynamic program over segments of bounded length chooses boundaries and kinds together.

The field is trained on runs with base spans, and on altered forms of these: other separators, no plus sign, spelt-out signs, two
spans in a row; wrong check digits, parts beyond 255 and more parts stand for what is none."""

from __future__ import annotations

import random
import re
import string
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import BATCH_ROWS, columns_of, dropped, fresh, in_small_batches, least_hashed, quoted, run_once, slices, stored, worker_cache

# The kinds in order, and the parts of their patterns. Quantifiers are possessive, which changes no match here.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", re.A)
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}", re.A)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+", re.A)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)
_DIGIT = re.compile("[0-9]")
_RUN = re.compile("[0-9]++")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")

#: Characters that a segment may be long; a longer entity is left to the patterns.
MAX_SEGMENT = 96
#: Full-width forms, which are read as their ASCII characters.
_FOLDED = {0xFF01 + i: 0x21 + i for i in range(94)} | {0xA0: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0x202F: 0x20}
_TO_FOLD = re.compile("[" + "".join(map(chr, _FOLDED)) + "]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; the local part of a sign is what stands before it, so the text is read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        end = max(end, at + 1)
        at = text.find("@", end)
    return out


def addresses(text: str) -> tuple[list, list]:
    """IP spans, and those that are none since a part is over 255."""
    good, bad, at = [], [], _DIGIT.search(text)
    at = at.start() if at else -1
    while at >= 0:
        found = _IP.match(text, at)
        if found:
            parts = found.group().split(".")
            (good if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in parts) else bad).append(found.span())
            at = found.end()
        else:
            at = _RUN.match(text, at).end()
        found = _DIGIT.search(text, at)
        at = found.start() if found else -1
    return good, bad


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the patterns' matches in order of kind and start, and of the matches that fail their test."""
    good = [(0, *x) for x in emails(text)]
    bad = []
    if _DIGIT.search(text):
        right, wrong = addresses(text)
        good += [(1, *x) for x in right]
        bad += [(1, *x) for x in wrong]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _digits(m.group())
                (good if 16 <= len(d) <= 19 and luhn(d) else bad).append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 8 <= len(_digits(m.group())) <= 15 else bad).append((3, *m.span()))
    return good, bad


# --- candidate segments ---

_AT = r"(?:[ ]?@[ ]?|[ ]?[\[({][ ]?(?:at|@)[ ]?[\])}][ ]?|[ ]at[ ])"
_DOT = r"(?:\.|[ ]?[\[({][ ]?(?:dot|\.)[ ]?[\])}][ ]?|[ ]dot[ ])"
_SIGN = re.compile(_AT, re.I)
_DOTS = re.compile(_DOT, re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++", re.A)
_NUMERIC = re.compile(r"(?:\+|\(|[0-9])[0-9 ().+/-]*+", re.A)
_SPELT = re.compile(r"@|[\[({][ ]?at[ ]?[\])}]|[ ]at[ ]", re.I)


@dataclass
class Segment:
    start: int
    end: int
    kind: int
    features: list[str]


@dataclass
class Run:
    """A stretch of text with its candidate segments; what they do not cover is no entity."""

    start: int
    end: int
    segments: list[Segment] = field(default_factory=list)


def _side(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def _shape(s: str) -> str:
    return re.sub("[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", s)


def _numeric(text: str, start: int, end: int) -> list[Segment]:
    """Segments of a run of digits and what may separate them: whole digit groups, no letter or digit beside them."""
    groups = [(m.start() + start, m.end() + start) for m in _RUN.finditer(text[start:end])]
    beside = lambda c: c.isalnum()
    out = []
    for i, (first, _) in enumerate(groups):
        if first > 0 and beside(text[first - 1]):
            continue
        n = 0
        for a, b in groups[i:]:
            n += b - a
            if n > 19 or b - first > MAX_SEGMENT:
                break
            if n < 4 or b < len(text) and beside(text[b]):
                continue
            body = text[first:b]
            between = sorted(set(body) - set("0123456789"))
            d = _digits(body)
            opening = first
            if opening > start and text[opening - 1] == "(" and ")" in body:
                opening -= 1
            if opening > start and text[opening - 1] == "+":
                opening -= 1
            before, after = text[opening - 1 : opening], text[b : b + 1]
            number_before = before in ("-", ".", "/") and text[opening - 2 : opening - 1].isdigit()
            number_after = after in ("-", ".", "/") and text[b + 1 : b + 2].isdigit()
            closed = body.count("(") + (text[opening] == "(" or text[opening : opening + 2] == "+(") == body.count(")")
            around = [f"before {_side(before)}", f"after {_side(after)}", f"goes on {number_before or number_after}"]
            seps = "".join(between)
            parts = body.split(".")
            if seps == "." and len(parts) == 4 and opening == first:
                fits = all(len(p) <= 3 and int(p) <= 255 for p in parts)
                out.append(Segment(first, b, 1, ["bias", f"fits {fits}", *around]))
            if 16 <= n and opening == first and not set(between) & set("()+"):
                sizes = [len(x) for x in re.split("[^0-9]+", body)]
                even = "one" if len(sizes) == 1 else "fours" if all(x == 4 for x in sizes[:-1]) and sizes[-1] <= 4 else "other"
                out.append(Segment(first, b, 2, ["bias", f"check {luhn(d)}", f"groups {even}", f"check {luhn(d)} groups {even}", f"separators {len(between)}", f"digits {n}", *around]))
            if 7 <= n <= 15:
                plus = text[opening] == "+"
                shape = _shape(text[opening + plus : b])
                out.append(Segment(opening, b, 3, ["bias", f"plus {plus}", f"plus {plus} digits {n}", f"shape {shape}", f"bracket {'(' in text[opening:b]} {closed}", f"separators {len(between)}", *around]))
    return out


def _spelt(text: str, sign: re.Match) -> Run | None:
    """The run around an at sign, in whichever form: labels joined by dots on both sides."""
    ends, at = [], sign.end()
    while len(ends) < 8 and (m := _LABEL.match(text, at)):
        ends.append(m.end())
        m = _DOTS.match(text, m.end())
        if not m:
            break
        at = m.end()
    starts, at = [], sign.start()
    while len(starts) < 8:
        start = at
        while start > max(0, sign.start() - MAX_SEGMENT) and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:
            break
        starts.append(start)
        before = _DOT_BEFORE.search(text[max(0, start - 8) : start])
        if not before:
            break
        at = start - (before.end() - before.start())
    if not starts or len(ends) < 2:
        return None
    spelt = re.sub(r"\s+", " ", sign.group().lower())
    run = Run(starts[-1], ends[-1])
    for start in starts:
        for k, end in enumerate(ends[1:], 2):
            if end - start > MAX_SEGMENT:
                continue
            last = _LABEL.findall(text[sign.end() : end])[-1]
            domain = text[sign.end() : end]
            dots = [m.group().lower() for m in _DOTS.finditer(domain)]
            plain = all(d == "." for d in dots)
            more = _DOTS.match(text, end) is not None and _LABEL.match(text, _DOTS.match(text, end).end()) is not None
            left = _DOT_BEFORE.search(text[max(0, start - 8) : start]) is not None
            run.segments.append(Segment(start, end, 0, [
                "bias", f"sign {spelt}", f"sign {spelt} plain {plain}", f"plain {plain}", f"labels {min(k, 4)}", f"goes on {more}", f"left {left}",
                f"last {'long' if len(last) > 6 else 'letters' if last.isalpha() and len(last) > 1 else 'other'}",
            ]))
    return run


_DOT_BEFORE = re.compile(r"(?:[ ]?[\[({][ ]?(?:dot|\.)[ ]?[\])}][ ]?|[ ]dot[ ])$", re.I)


def runs_of(text: str) -> list[Run]:
    """Runs of a text that may hold an entity, in order; those that overlap are one."""
    if _TO_FOLD.search(text):
        text = text.translate(_FOLDED)
    found = []
    if _DIGIT.search(text):
        for m in _NUMERIC.finditer(text):
            if m.end() - m.start() >= 7 and len(_digits(m.group())) >= 7 and (segments := _numeric(text, m.start(), m.end())):
                found.append(Run(min(s.start for s in segments), max(s.end for s in segments), segments))
    if _SPELT.search(text):
        at = 0
        while m := _SIGN.search(text, at):
            if run := _spelt(text, m):
                found.append(run)
            at = max(m.start() + 1, m.end() - 1)
    found.sort(key=lambda r: r.start)
    out: list[Run] = []
    for run in found:
        if out and run.start < out[-1].end:
            out[-1].end = max(out[-1].end, run.end)
            out[-1].segments += run.segments
        else:
            out.append(run)
    return out


# --- the field ---


@dataclass
class SemiMarkovField:
    """Weights of (kind, feature) buckets, and of one kind following another within a run (the last column: nothing before)."""

    weight: np.ndarray
    follows: np.ndarray

    def buckets(self, s: Segment) -> list[int]:
        return [zlib.crc32(f"{s.kind} {x}".encode()) % len(self.weight) for x in s.features]

    def score(self, s: Segment) -> float:
        return float(sum(self.weight[b] for b in self.buckets(s)))

    def best(self, segments: list[Segment], taken: list[tuple[int, int]] = ()) -> list[Segment]:
        """The likeliest segments that overlap neither each other nor what is `taken` (spans in order, apart from each other); none
        where nothing is likelier.

        States are places and the kind of the last entity; segments are of bounded length, so the work grows with
        their number only."""
        ends = [b for _, b in taken]
        free = [s for s in segments if (i := bisect_left(ends, s.start + 1)) == len(taken) or s.end <= taken[i][0]]
        points = sorted({p for s in free for p in (s.start, s.end)})
        place = {p: i for i, p in enumerate(points)}
        by_end: dict[int, list[tuple[Segment, float]]] = {}
        for s in sorted(free, key=lambda s: (s.start, s.end, s.kind)):
            by_end.setdefault(place[s.end], []).append((s, self.score(s)))
        none = len(KINDS)
        best = [[-np.inf] * (none + 1) for _ in points]
        back: list[list] = [[None] * (none + 1) for _ in points]
        for i in range(len(points)):
            if i == 0:
                best[0][none] = 0.0
                continue
            best[i], back[i] = list(best[i - 1]), list(back[i - 1])
            for s, score in by_end.get(i, ()):
                at = place[s.start]
                for last in range(none + 1):
                    value = best[at][last] + score + self.follows[last, s.kind]
                    if value > best[i][s.kind]:
                        best[i][s.kind], back[i][s.kind] = value, (s, at, last)
        if not points:
            return []
        last, out, i = int(np.argmax([*best[-1][:none], best[-1][none]])), [], len(points) - 1
        if best[-1][last] <= best[-1][none]:
            last = none
        while last != none:
            s, i, last = back[i][last]
            out.append(s)
        return out[::-1]


def train(runs: list[tuple[list[Segment], set[tuple[int, int, int]]]], buckets: int = 1 << 16, rounds: int = 60, prior: float = 0.02, rate: float = 0.5) -> SemiMarkovField:
    """Maximum likelihood with a Gaussian prior, by forward and backward sums over all segmentations of all runs at once. A run is
    its candidates and the (start, end, kind) among them that are entities; those must not overlap."""
    model = SemiMarkovField(np.zeros(buckets), np.zeros((len(KINDS) + 1, len(KINDS))))
    none = len(KINDS)
    of, start, end, kind, gold, feats, sizes, width, follow_gold = [], [], [], [], [], [], [], 1, np.zeros_like(model.follows)
    for r, (segments, truth) in enumerate(runs):
        points = sorted({p for s in segments for p in (s.start, s.end)})
        place = {p: i for i, p in enumerate(points)}
        width = max(width, len(points))
        for s in segments:
            of.append(r), start.append(place[s.start]), end.append(place[s.end]), kind.append(s.kind), gold.append((s.start, s.end, s.kind) in truth)
            own = model.buckets(s)
            feats += own
            sizes.append(len(own))
        last = none
        for s in sorted((s for s in segments if (s.start, s.end, s.kind) in truth), key=lambda s: s.start):
            follow_gold[last, s.kind] += 1
            last = s.kind
    if not of:
        return model
    of, start, end, kind, gold, feats, sizes = (np.array(x) for x in (of, start, end, kind, gold, feats, sizes))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(of)), sizes)
    ending, starting = [np.flatnonzero(end == p) for p in range(width)], [np.flatnonzero(start == p) for p in range(width)]
    sq, sq_follow = np.ones(buckets), np.ones_like(model.follows)
    for _ in range(rounds):
        score = np.add.reduceat(model.weight[feats], first)
        alpha = np.full((width, len(runs), none + 1), -np.inf)
        alpha[0, :, none] = 0
        for p in range(1, width):
            alpha[p] = alpha[p - 1]
            c = ending[p]
            if len(c):
                value = np.logaddexp.reduce(alpha[start[c], of[c]] + model.follows[:, kind[c]].T, axis=1) + score[c]
                np.logaddexp.at(alpha[p], (of[c], kind[c]), value)
        beta = np.zeros((width, len(runs), none + 1))
        for p in range(width - 2, -1, -1):
            beta[p] = beta[p + 1]
            c = starting[p]
            if len(c):
                value = model.follows[:, kind[c]].T + (score[c] + beta[end[c], of[c], kind[c]])[:, None]
                np.logaddexp.at(beta[p], of[c], value)
        total = beta[0, :, none]
        into = alpha[start, of] + model.follows[:, kind].T + (score + beta[end, of, kind] - total[of])[:, None]
        p_follow = np.exp(into)
        p = p_follow.sum(axis=1)
        gradient = np.bincount(feats, weights=(gold - p)[owner], minlength=buckets) - prior * model.weight
        expected = np.zeros_like(model.follows)
        for k in range(none):
            expected[:, k] = p_follow[kind == k].sum(axis=0)
        gradient_follow = follow_gold - expected - prior * model.follows
        sq += gradient**2
        sq_follow += gradient_follow**2
        model.weight += rate * gradient / np.sqrt(sq)
        model.follows += rate * gradient_follow / np.sqrt(sq_follow)
    return model


# --- training runs ---

#: Characters around a run that go along with it, and of a run that is learned from.
CONTEXT, MAX_RUN = 30, 240


def _around(text: str, run: Run) -> tuple[str, list, bool]:
    """A run with its surroundings, the base spans in it, and whether a match that failed may hold several entities."""
    a, b = max(0, run.start - CONTEXT), min(len(text), run.end + CONTEXT)
    piece = text[a:b]
    good, bad = base_spans(piece)
    own = [(k, s, e) for k, s, e in good if s < run.end - a and e > run.start - a]
    several = any((k == 2 and len(_digits(piece[s:e])) > 19) or (k == 3 and len(_digits(piece[s:e])) > 15) for k, s, e in bad if s < run.end - a and e > run.start - a)
    return piece, own, several


def altered(piece: str, kind: int, start: int, end: int, rnd: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Other forms of a piece with one base span: (piece, spans)."""
    left, span, right = piece[:start], piece[start:end], piece[end:]
    if kind == 0:
        at = span.index("@")
        local, domain = span[:at], span[at + 1 :]
        forms = [f"{local} at {domain.replace('.', ' dot ')}", f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}", f"{local} @ {domain}"]
        return [(left + f + right, [(0, len(left), len(left) + len(f))]) for f in forms] + [(f"{left}{word} at {domain}{right}", []) for word in (local, "look")]
    digits = _digits(span)
    if kind == 1:
        parts = span.split(".")
        wrong = [".".join([*parts[:3], str(int(parts[3]) + 256)]), span + "." + parts[0], ".".join(parts[:3])]
        return [(left + w + right, []) for w in wrong]
    if kind == 2:
        out = []
        for sep in ("", " ", "-", ".", "/"):
            form = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
            off = form[:-1] + str((int(form[-1]) + rnd.randint(1, 9)) % 10)
            out += [(left + form + right, [(2, len(left), len(left) + len(form))]), (left + off + right, [])]
        return out
    forms = [span[1:], span.replace(" ", "-")]
    if m := re.match(r"\+[0-9]{1,3}[ -]", span):
        forms.append(span[m.end() :])
    out = [(left + f + right, [(3, len(left), len(left) + len(f))]) for f in forms if len(_digits(f)) >= 7 and (f[0] == "(" or re.search(r"[ ).-]", f))]
    return [*out, (left + digits + right, []), (left + digits[-7:-4] + "-" + digits[-4:] + right, [])]


def training_runs(pieces: list[tuple[str, list]], seed: int = 11) -> list[tuple[list[Segment], set[tuple[int, int, int]]]]:
    """The pieces as they are, altered forms of those with one span, and pairs of spans in a row."""
    rnd = random.Random(seed)
    forms = [(p, [(k, s, e) for k, s, e in spans]) for p, spans in pieces]
    for piece, spans in pieces:
        if len(spans) == 1:
            forms += altered(piece, *spans[0], rnd)
    single = [(p, s[0]) for p, s in pieces if len(s) == 1 and s[0][0] in (2, 3)]
    for (p, (k, s, e)), (q, (l, t, u)) in zip(single, single[1:] + single[:1], strict=True):
        gap = rnd.choice([" ", "  ", " - "])
        a, b = p[s:e], q[t:u]
        forms.append((p[:s] + a + gap + b + q[u:], [(k, s, e), (l, s + len(a) + len(gap), s + len(a) + len(gap) + len(b))]))
    out = []
    for piece, spans in forms:
        truth = {(s, e, k) for k, s, e in spans}
        for run in runs_of(piece):
            known = {(s.start, s.end, s.kind) for s in run.segments}
            inside = {x for x in truth if run.start <= x[0] and x[1] <= run.end}
            if inside <= known:  # a span that is no candidate is the patterns' alone
                out.append((run.segments, inside))
    return out


@in_small_batches
def fit(docs: DataFrame, max_runs: int = 400, text_col: str = "text") -> SemiMarkovField | None:
    """A field from the runs of `docs`: with a base span of each kind, and without one, at most `max_runs` of each, those of least
    hash; longer ones than 240 characters and those that may hold several entities are left out. None without base spans."""
    texts = docs.select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        worker_cache("personal data", dict)
        for batch in slices(batches):
            label, piece = [], []
            for text in batch.column(0).to_pylist():
                for r in runs_of(text):
                    if r.end - r.start <= MAX_RUN:
                        p, spans, several = _around(text, r)
                        if not several and len(spans) <= 1:
                            label.append(spans[0][0] if spans else -1)
                            piece.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(piece, pa.string())], ["label", "piece"])

    found = stored(texts.mapInArrow(run, "label int, piece string").withColumn("h", F.shiftrightunsigned(F.xxhash64("piece"), 1)))
    chosen = least_hashed(found.select("label", "h").distinct(), max_runs)
    rows = found.join(F.broadcast(chosen), ["label", "h"]).select("label", "piece").distinct().collect()  # bounded by max_runs
    dropped(found)
    pieces = []
    for _, piece in sorted((r[0], r[1]) for r in rows):
        spans = base_spans(piece)[0]
        if len(spans) <= 1:
            pieces.append((piece, spans))
    return train(training_runs(pieces)) if any(s for _, s in pieces) else None


def spans_of(text: str, model: SemiMarkovField | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base spans, and of those that the field adds; places count characters."""
    base, _ = base_spans(text)
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(taken[-1][1], e)
        else:
            taken.append((s, e))
    added, ends = [], [e for _, e in taken]
    if model is not None:
        for run in runs_of(text):
            first = bisect_left(ends, run.start + 1)
            own = taken[first : bisect_left(ends, run.end + 1, first) + 1]
            added += [(s.kind, s.start, s.end) for s in model.best(run.segments, own)]
    return sorted(base), sorted(added)


def find(docs: DataFrame, model: SemiMarkovField | None, text_col: str = "text") -> DataFrame:
    """`docs` with, last, _base and _spans: arrays of (kind, first, end) by kind (email, ip, card, phone) and place, the patterns'
    spans and all spans; where `docs` has a column of that name, ours has more underscores behind. Places are
    characters, the end exclusive. One row per row; null and empty texts have no spans; whole texts are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    found, base, spans = fresh(docs.columns, "_found", "_base", "_spans")
    item = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())])

    def run(texts: pa.Array) -> pa.Array:
        worker_cache("personal data", dict)
        columns = [], []
        for i in range(0, len(texts), BATCH_ROWS):
            for text in texts.slice(i, BATCH_ROWS).to_pylist():
                own, added = spans_of(text or "", held.value)
                for column, rows in zip(columns, (own, sorted(own + added)), strict=True):
                    column.append([{"kind": KINDS[k], "first": s, "end": e} for k, s, e in rows])
        return pa.StructArray.from_arrays([pa.array(c, pa.list_(item)) for c in columns], ["base", "spans"])

    kind = "array<struct<kind: string, first: bigint, end: bigint>>"
    udf = run_once(run, f"base {kind}, spans {kind}", F.arrow_udf)
    return docs.select(*columns_of(docs), udf(F.col(quoted(text_col)).cast("string")).alias(found)).select(*columns_of(docs), F.col(f"{found}.base").alias(base), F.col(f"{found}.spans").alias(spans))


def redacted(docs: DataFrame, model: SemiMarkovField | None, text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans are one, of the first one's kind. Null stays null."""
    (spans,) = fresh(docs.columns, "_spans")
    found = find(docs.select(*columns_of(docs)), model, text_col)
    names = found.columns[len(docs.columns) :]
    marked = found.select(*columns_of(docs), F.array_sort(F.transform(F.col(names[1]), lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"), x["kind"].alias("kind")))).alias(spans))
    text = quoted(text_col)
    step = f"if(x.first >= acc.at, struct(concat(acc.out, substr({text}, acc.at + 1, x.first - acc.at), '[', x.kind, ']') AS out, x.end AS at), struct(acc.out AS out, greatest(acc.at, x.end) AS at))"
    whole = F.expr(f"aggregate({spans}, struct('' AS out, 0L AS at), (acc, x) -> {step}, acc -> concat(acc.out, substr({text}, acc.at + 1)))")
    return marked.select(*[whole.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])


def spelled(spans: str) -> Column:
    """kind:first:end of each of the spans, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["end"].cast("string"))), ",")
