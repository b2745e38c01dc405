"""Substring dedup by paragraphs: MinHash banding for near copies, equal segments for passages inside paragraphs.

A paragraph is a line, or a block of lines between blank lines, of at least `min_words` words (repeated shorter ones are the
line dedup's); a line within a block that goes has no say of its own, so that what stays stands in no block that goes. The
MinHash over shingles of five words has 30 coordinates in 10 bands of three, so that a pair of similarity 0.8 shares a band
with a probability over 0.999. What shares a band is compared exactly (Jaccard of
their shingle sets), first with two leaders of the band's group, then, where these leave classes apart, by prefixes of
rare shingles (see rare_prefixes), which pass over no similar pair. Classes are the connected components.

A passage that stands in the middle of different paragraphs makes none of them similar. Texts are therefore also cut
where a pair of words has the least hash of 20 pairs in a row. These cuts depend on the words alone: a common passage
of 50 words or more is cut alike wherever it stands, and the segments between its cuts are equal. Equal segments are a
class of their own kind (similarity 1); those that together make a run of `min_run` words count as a passage, with the words
before and behind that go on alike.

Words are what ASCII white space separates, compared without ASCII case. Of every class the first place stays, all
others are removals."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import rare_prefixes
from webloom.llm.common import dropped, fresh, in_small_batches, quoted, run_once, slices, stored
from webloom.llm.components import connected_components
from webloom.llm.near_dedup import GOLDEN, M1, M2, _small, bucket_pairs, mix, shared_groups
from webloom.llm.repeats import VALUE, both_powers, packed

K, BANDS, SHINGLE, PAIRS = 30, 10, 5, 20
#: Bits of a paragraph's shingles by which almost similar ones are told apart, and rare shingles that go along with each.
N_BITS, EARLIER = 1024, 16
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = re.compile(rb"[^\t-\r ]+")
#: Odd multipliers and offsets of the 16 hash functions, from a fixed seed.
A, B = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, K), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, hash and line number (from line ends alone) of each word."""
    edge = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = both_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(VALUE[LOWER[data]] * power[:-1], out=sums[1:])
    return first, end, mix((sums[end] - sums[first]) * inverse[first]), np.cumsum(data == 10)[first]


def runs_hash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each run of words a..b-1, the same wherever it stands."""
    power, inverse = both_powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        out = mix(out + words[j : j + len(out)] + GOLDEN)
    return out


def mix_in_place(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """mix(x), written over x; t is as long."""
    for shift, factor in ((30, M1), (27, M2), (31, None)):
        np.right_shift(x, np.uint64(shift), out=t)
        x ^= t
        if factor is not None:
            x *= factor
    return x


def paragraph_spans(first: np.ndarray, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, whether it is a block) of the paragraphs as runs of words a..b-1: all lines, and in texts with blank lines what
    stands between these, if it has several lines."""
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    text, step = np.searchsorted(starts, first, side="right") - 1, np.diff(line)
    other = np.diff(text) != 0
    blank = (step > 1) & ~other
    by_blank = np.bincount(text[1:][blank], minlength=len(starts)) > 0
    line_at = np.flatnonzero(np.concatenate([[True], other | (step != 0)]))
    block_at = np.flatnonzero(np.concatenate([[True], other | blank]))
    line_end, block_end = np.append(line_at[1:], len(first)), np.append(block_at[1:], len(first))
    several = by_blank[text[block_at]] & (line[block_end - 1] != line[block_at])
    return np.concatenate([line_at, block_at[several]]), np.concatenate([line_end, block_end[several]]), np.repeat([False, True], [len(line_at), int(several.sum())])


def paragraph_units(data: np.ndarray, starts: np.ndarray, min_words: int):
    """(first, end, n_words, block, h1, h2, bands) of the paragraphs in a buffer of texts that begin at `starts`."""
    first, end, words, line = words_of(data)
    a, b, block = paragraph_spans(first, line, starts)
    long = b - a >= min_words
    a, b, block = a[long], b[long], block[long]
    if not len(a):
        return None
    n = b - a - SHINGLE + 1
    offsets = np.cumsum(n) - n
    inside = np.repeat(a - offsets, n) + np.arange(n.sum())
    shingle = shingle_hashes(words)[inside]
    least, x, t = np.empty((K, len(a)), dtype=np.uint64), np.empty_like(shingle), np.empty_like(shingle)
    for k in range(K):
        np.multiply(shingle, A[k], out=x)
        x += B[k]
        np.minimum.reduceat(mix_in_place(x, t), offsets, out=least[k])
    bands = np.zeros((BANDS, len(a)), dtype=np.uint64)
    for r in range(K // BANDS):
        bands = mix(bands + least[r :: K // BANDS] + GOLDEN)
    return first[a], end[b - 1], b - a, block, runs_hash(words, a, b), runs_hash(mix(words ^ GOLDEN), a, b), bands.T.astype(np.uint32).view(np.int32)


def cut_places(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Word numbers before which texts are cut, from the words of a buffer and the text that each belongs to."""
    pair = mix(words[:-1] * A[0] + words[1:])
    low = np.uint64((1 << 24) - 1)
    out = [np.zeros(0, dtype=np.int64)]
    for start in range(0, len(pair) - PAIRS + 1, 1 << 23):  # overlapping parts of very long texts
        part = pair[start : start + (1 << 23) + PAIRS - 1]
        m, w = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * w <= PAIRS:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        n = len(part) - PAIRS + 1
        m = np.minimum(m[:n], m[PAIRS - w : PAIRS - w + n])
        m = m[text[start : start + n] == text[start + PAIRS : start + PAIRS + n]]  # pairs in a row are those of one text
        m = m[np.append(True, m[1:] != m[:-1])] if len(m) else m
        out.append(np.unique(m & low).astype(np.int64) + start)
    return np.unique(np.concatenate(out)) + 1


def seen_before(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the same h and n stand earlier in the same text."""
    order = np.lexsort((n, h, text))
    t, x, m = text[order], h[order], n[order]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:]] = (t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (m[1:] == m[:-1])
    return out


def buffers(docs: list, texts: list, most: int = 300_000):
    """Texts put together line after line: documents, their first bytes, the buffer. So small that its numbers stay in a
    processor's cache."""
    ids, starts, parts, size = [], [], [], 0
    for doc, text in zip(docs, texts, strict=True):
        b = text if isinstance(text, bytes) else (text or "").encode()
        ids.append(doc)
        starts.append(size)
        parts.append(b + b"\n")
        size += len(b) + 1
        if size > most:
            yield np.array(ids), np.array(starts), np.frombuffer(b"".join(parts), dtype=np.uint8)
            ids, starts, parts, size = [], [], [], 0
    if ids:
        yield np.array(ids), np.array(starts), np.frombuffer(b"".join(parts), dtype=np.uint8)


def paragraphs(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                for ids, starts, data in buffers(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = paragraph_units(data, starts, min_words)
                    if found is None:
                        continue
                    first, end, n, block, h1, h2, bands = found
                    who = np.searchsorted(starts, first, side="right") - 1
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(first - starts[who]), pa.array(end - starts[who]), pa.array(n.astype(np.int64)), pa.array(block), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), flat], ["doc", "first", "end", "n_words", "block", "h1", "h2", "bands"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, first long, end long, n_words long, block boolean, h1 long, h2 long, bands array<int>")


def segments(docs: DataFrame) -> DataFrame:
    """The segments of each text between its cuts; `again`: the same stands earlier in this text."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                for ids, starts, data in buffers(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    first, end, words, _ = words_of(data)
                    text = np.searchsorted(starts, first, side="right") - 1
                    cuts = cut_places(words, text)
                    who = text[cuts]
                    inner = who[:-1] == who[1:]  # what lies before the first cut and after the last may be cut otherwise elsewhere
                    a, b, number = cuts[:-1][inner], cuts[1:][inner], (np.arange(len(cuts)) - np.searchsorted(who, who))[:-1][inner]
                    if not len(a):
                        continue
                    who, n = text[a], (b - a).astype(np.int64)
                    h = runs_hash(words, a, b).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(number), pa.array(first[a] - starts[who]), pa.array(end[b - 1] - starts[who]), pa.array(n), pa.array(h), pa.array(seen_before(who, h, n))], ["doc", "number", "first", "end", "n_words", "h", "again"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, number long, first long, end long, n_words long, h long, again boolean")


def shingle_sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the distinct shingles of the wanted nodes, from packed() texts."""
    wanted = wanted.select("node").join(nodes.select("node", "doc", "first", "end"), "node")
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("node", "first", "end")).alias("spans"))  # as many as one text has

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                nodes_, parts = [], []
                for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    data = press.decompress(z)
                    nodes_ += [s["node"] for s in spans]
                    parts += [data[s["first"] : s["end"]] for s in spans]
                for ids, starts, data in buffers(nodes_, parts):
                    first, _, words, _ = words_of(data)
                    at, shingle = np.append(np.searchsorted(first, starts), len(first)), shingle_hashes(words)
                    sets = [np.unique(shingle[a : max(a, b - SHINGLE + 1)]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return stored(texts.join(by_doc, "doc").mapInArrow(run, "node long, set binary"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), stored, whose shingle sets (node, set) are similar."""
    exact = run_once(rare_prefixes.jaccard, "double")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return stored(both.select("a", "b", exact("x", "y").alias("similarity")).filter(F.col("similarity") >= threshold).select("a", "b"))


def near_paragraphs(docs: DataFrame, texts: DataFrame, threshold: float, min_words: int) -> DataFrame:
    """(doc, first, end, n_words, class_doc, class_first) of the paragraphs in classes of two places or more."""
    units = stored(paragraphs(docs, min_words))
    place = F.struct("doc", "first")
    distinct = units.groupBy("h1", "h2").agg(F.count("*").alias("places"), F.min(F.struct("doc", "first", "end")).alias("one"), F.any_value("bands").alias("bands"))
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "places", "one.*", "bands"))
    groups = shared_groups(nodes)
    pairs = bucket_pairs(groups)
    # every node of a group is in a pair, so that these are the sets of all nodes that are compared below
    compared = shingle_sets(texts, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = similar_pairs(pairs, compared, threshold)
    joined = connected_components(links)
    left = rare_prefixes.open_nodes(groups, joined)
    sets = stored(compared.join(left, "node").select("node", "label", "set"))
    dropped(pairs, compared)
    rest = rare_prefixes.links_between(sets, threshold, N_BITS, EARLIER).select("a", "b")
    linked = F.col("label").isNotNull().alias("linked")
    named = nodes.join(joined, "node", "left").select("h1", "h2", "places", place.alias("place"), F.coalesce("label", "node").alias("label"), linked)
    if rest.limit(1).count():
        # classes, not paragraphs, are what is still to be put together: a pair of classes counts once
        of = lambda end: left.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        between = stored(rest.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        above = _small(connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("above")))
        linked = (F.col("linked") | F.col("above").isNotNull()).alias("linked")
        named = named.join(above, "label", "left").select("h1", "h2", "places", "place", F.coalesce("above", "label").alias("label"), linked)
    labels = stored(named.filter("places > 1 OR linked").drop("linked"))  # all others are alone in their classes
    dropped(groups, left, sets, links)
    classes = stored(labels.groupBy("label").agg(F.sum("places").alias("places"), F.min("place").alias("least")).filter("places > 1").select("label", "least"))
    member = stored(labels.join(classes, "label").select("h1", "h2", "label", "least"))
    rows = stored(units.drop("bands").join(member.hint("shuffle_hash"), ["h1", "h2"]).select("doc", "first", "end", "n_words", "block", "label", "least"))
    # lines within a block that goes: blocks of a text are apart, so the last one that begins before a line decides
    gone = F.when(F.col("block") & (place != F.col("least")), F.struct("first", "end"))
    before = Window.partitionBy("doc").orderBy("first", F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    left = stored(rows.withColumn("gone", F.last(gone, ignorenulls=True).over(before)).filter(F.col("block") | F.col("gone").isNull() | (F.col("first") >= F.col("gone.end"))).drop("gone", "least"))
    again = stored(left.groupBy("label").agg(F.count("*").alias("places"), F.min(place).alias("least")).filter("places > 1").select("label", "least"))
    dropped(units, nodes, labels, classes, member, rows)
    return left.join(again, "label").select("doc", "first", "end", "n_words", F.col("least.doc").alias("class_doc"), F.col("least.first").alias("class_first"))


def equal_passages(docs: DataFrame, texts: DataFrame, min_run: int) -> DataFrame:
    """The same for segments that stand in two places or more and make runs of `min_run` words, and for the words at both
    ends of a run that go on alike (see run_ends)."""
    found = stored(segments(docs))
    # minima of numbers, which Spark aggregates by hash; of places in one text those seen before are passed over.
    # Stored, so that the join has nothing but exchanges below it and Spark can split a hot segment; no key is twice in the
    # side that is hashed.
    own = F.when(~F.col("again"), F.col("doc"))
    least = F.min("doc").alias("least_doc"), F.min_by("first", own).alias("least_first"), F.min_by("end", own).alias("least_end")
    twice = stored(found.groupBy("h", "n_words").agg(F.count("*").alias("places"), *least).filter("places > 1").drop("places"))
    repeated = stored(found.drop("again").join(twice.hint("shuffle_hash"), ["h", "n_words"]).drop("h"))
    dropped(found, twice)
    in_text = Window.partitionBy("doc").orderBy("number")
    opens = F.coalesce(F.col("number") > F.lag("number").over(in_text) + 1, F.lit(True))
    closes = F.coalesce(F.col("number") + 1 < F.lead("number").over(in_text), F.lit(True))
    island = repeated.select("*", (F.col("number") - F.row_number().over(in_text)).alias("island"), opens.alias("opens"), closes.alias("closes"))
    run = island.withColumn("run", F.sum("n_words").over(Window.partitionBy("doc", "island")))
    run = stored(run.filter(F.col("run") >= min_run).drop("number", "island", "run"))
    dropped(repeated)
    whole = run.select("doc", "first", "end", "n_words", F.col("least_doc").alias("class_doc"), F.col("least_first").alias("class_first"))
    return whole.withColumn("kind", F.lit("passage")).unionByName(run_ends(run, texts).withColumn("kind", F.lit("edge")))


def run_ends(run: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, first, end, n_words, class_doc, class_first): the words before a run's first segment (`opens`) and behind its
    last one (`closes`) that are those of the place where that segment stands first, in another text. They are at most
    PAIRS, since what goes on alike for longer is cut alike; the segments beside a run stand nowhere else, so nothing that
    is kept is touched. A run whose outermost segment stands first itself, cut otherwise than in a text before, keeps that
    segment."""
    side = lambda is_end, before, own: F.struct(F.col(is_end).alias("is_end"), F.lit(before).alias("before"), F.col(own).alias("at"), F.col(f"least_{own}").alias("of_at"))
    outer = run.filter("(opens OR closes) AND doc <> least_doc").select("doc", F.col("least_doc").alias("of_doc"), F.explode(F.array(side("opens", True, "first"), side("closes", False, "end"))).alias("s"))
    sides = stored(outer.filter("s.is_end").select("s.before", "doc", "s.at", "of_doc", "s.of_at"))
    asked = sides.select("before", "doc", "at").union(sides.select("before", F.col("of_doc").alias("doc"), F.col("of_at").alias("at"))).distinct()
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("before", "at")).alias("asked"))

    def words_beside(data: bytes, at: int, before: bool) -> bytes:
        size = 256
        while True:
            part = data[max(0, at - size) : at] if before else data[at : at + size]
            if len(part) < size or len(part.split()) > PAIRS + 1:
                return part
            size *= 2

    def run_(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            out = [], [], [], []
            for doc, z, places in zip(batch.column("doc").to_pylist(), batch.column("z").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                data = press.decompress(z)
                for x in places:
                    for column, value in zip(out, (doc, x["before"], x["at"], words_beside(data, x["at"], x["before"])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["doc", "before", "at", "beside"])

    beside = stored(texts.join(by_doc, "doc").select("doc", "z", "asked").mapInArrow(run_, "doc long, before boolean, at long, beside binary"))
    other = beside.select(F.col("doc").alias("of_doc"), "before", F.col("at").alias("of_at"), F.col("beside").alias("of_beside"))
    both = sides.join(beside, ["doc", "before", "at"]).join(other, ["of_doc", "before", "of_at"])

    def common(before: pd.Series, mine: pd.Series, other: pd.Series) -> pd.DataFrame:
        rows = []
        for side, a, b in zip(before, mine, other, strict=True):
            a, b = bytes(a).lower(), bytes(b).lower()
            if side:  # backwards from the end
                a, b = a[::-1], b[::-1]
            n, x, y, last_x, last_y = 0, None, None, None, None
            for p, q in zip(WORD.finditer(a), WORD.finditer(b)):
                if n == PAIRS or p[0] != q[0]:
                    break
                if not n:
                    x, y = p, q
                n, last_x, last_y = n + 1, p, q
            if not n:
                rows.append((0, 0, 0, 0, 0))
            elif side:
                rows.append((n, -last_x.end(), -x.start(), -last_y.end(), -y.start()))
            else:
                rows.append((n, x.start(), last_x.end(), y.start(), last_y.end()))
        return pd.DataFrame(rows, columns=["n", "first", "end", "of_first", "of_end"])

    schema = "n long, first long, end long, of_first long, of_end long"
    got = both.select("doc", "at", "of_doc", "of_at", run_once(common, schema)("before", "beside", "of_beside").alias("c")).filter("c.n > 0")
    of_first = F.col("of_at") + F.col("c.of_first")
    edge = lambda doc, at, first, end: F.struct(F.col(doc).alias("doc"), (F.col(at) + F.col(first)).alias("first"), (F.col(at) + F.col(end)).alias("end"), F.col("c.n").alias("n_words"), F.col("of_doc").alias("class_doc"), of_first.alias("class_first"))
    # what goes and what stays, from one comparison
    edges = got.select(F.explode(F.array(edge("doc", "at", "c.first", "c.end"), edge("of_doc", "of_at", "c.of_first", "c.of_end"))).alias("e"))
    found = stored(edges.select("e.*").distinct())
    dropped(sides, beside)
    return found


@in_small_batches
def duplicates(docs: DataFrame, threshold: float = 0.8, min_words: int = 16, min_run: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated paragraph, passage segment and edge of a passage: id_col, _kind ('paragraph', 'passage' or 'edge'), _first and _end
    (bytes of its text), _n_words, _class_id and _class_first (id and byte of the class's first place), _removed
    (false for that place alone) and _text.

    Texts without repeats have no rows; a null text is empty. Null or repeated ids are told apart by a number for
    each row; then _text is a hash of the row's text, else null. Other columns are not read. Memory follows the longest
    text."""
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    plain = dict(rows.dtypes)["_id"] == "bigint" and not rows.groupBy("_id").count().filter("count > 1 OR _id IS NULL").limit(1).count()
    keyed = rows.withColumn("doc", F.col("_id")) if plain else stored(rows.withColumn("doc", F.monotonically_increasing_id()))
    texts = stored(packed(keyed.select("doc", "text")))
    found = near_paragraphs(keyed, texts, threshold, min_words).withColumn("kind", F.lit("paragraph")).unionByName(equal_passages(keyed, texts, min_run))
    removed = (F.col("doc") != F.col("class_doc")) | (F.col("first") != F.col("class_first"))
    own, of, text = F.col("doc"), F.col("class_doc"), F.lit(None).cast("long")
    if not plain:
        ids = keyed.select("doc", "_id", F.xxhash64("text").alias("_text"))
        text = F.col("_text")
        found = found.join(ids, "doc").join(ids.select(F.col("doc").alias("class_doc"), F.col("_id").alias("_of")), "class_doc")
        own, of = F.col("_id"), F.col("_of")
    return found.select(own.alias(id_col), F.col("kind").alias("_kind"), F.col("first").alias("_first"), F.col("end").alias("_end"), F.col("n_words").alias("_n_words"), of.alias("_class_id"), F.col("class_first").alias("_class_first"), removed.alias("_removed"), text.alias("_text"))


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the removed spans of duplicates(); all rows stay. Rows of one id (null is an id like any other) are told
    apart by their texts; rows that are equal in both stay alike, and keep what stays in one of them."""
    (name,) = fresh(docs.columns, "_spans")
    by_place = found.groupBy(F.col(quoted(id_col)).alias("of"), F.col("_text").alias("of_text"), "_kind", "_first", "_end").agg(F.every("_removed").alias("removed"))
    spans = by_place.filter("removed").groupBy("of", "of_text").agg(F.collect_list(F.struct(F.col("_first").alias("a"), F.col("_end").alias("b"))).alias(name))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found_ in zip(texts, spans, strict=True):
            if text is None or found_ is None:
                out.append(text)
                continue
            data, parts, at = text.encode(), [], 0
            for s in sorted(found_, key=lambda s: s["a"]):
                parts.append(data[at : max(at, s["a"])])
                at = max(at, s["b"])
            out.append(b"".join([*parts, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    own = F.xxhash64(docs[quoted(text_col)].cast("string"))
    joined = docs.join(spans, docs[quoted(id_col)].eqNullSafe(spans["of"]) & (spans["of_text"].isNull() | (spans["of_text"] == own)), "left")
    text = F.pandas_udf(cut, "string")(docs[quoted(text_col)], spans[name])
    return joined.select(*[text.alias(c) if c == text_col else docs[quoted(c)] for c in docs.columns])
