"""Repeated byte strings: sparse distributed prefix doubling.

Wanted are all starts of 200-byte strings that start anywhere else too. Doubling over every byte position
would sort the whole input's positions four times; here it runs on positions that cannot be unique:

1. Sampling. Of the 50-byte grams inside a 200-byte string the one of least hash is its anchor, the
   same wherever the string stands. Starts with one anchor in a row make a node: about one in 64 bytes.
2. Rank by the first 50 bytes: nodes whose anchor gram occurs once hold no repeated string and go.
3. Rank by (gram, hull), the hull being all bytes under the node's strings: nodes with equal pairs are repeated
   in full. This settles the inside of long copies, whatever their number.
4. Prefix doubling. What is left are the ends of copies: nodes that share the gram but not the hull. Sorted
   by gram, their starts are ranked by pairs of ranks at growing offsets, 25, 50, 100, 200 bytes, and drop out
   as soon as they are unique.

Ranks are fingerprints: a class is known by 64 bits of its gram and 64 bits of what is compared, 128 in all."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, in_small_batches, quoted, slices, stored

GRAM = 50
#: Starts that are looked at together in one text: a bound on memory.
CHUNK = 1_000_000
#: Nodes of one gram up to which a task compares them by itself; beyond, their starts are counted by Spark.
HOT = 20_000
BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A random odd number for each byte value.
VALUE = np.random.Generator(np.random.PCG64(42)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64(0xFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    return powers(BASE, size)[:n], powers(pow(BASE, -1, 2**64), size)[:n]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of value times power; see cut."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(VALUE[data] * both_powers(len(data))[0], out=out[1:])
    return out


def nodes_of(data: np.ndarray, length: int = 200) -> tuple[np.ndarray, ...]:
    """gram, hull, anchor, first start and last start of each node of a text."""
    found = []
    for begin in range(0, len(data) - length + 1, CHUNK):
        piece = data[begin : begin + CHUNK + length - 1]
        s, inverse = sums(piece), both_powers(len(piece))[1]
        gram = (s[GRAM:] - s[:-GRAM]) * inverse[: len(piece) - GRAM + 1]
        window, n = length - GRAM + 1, len(piece) - length + 1
        least = (mix(gram) & ~LOW) | np.arange(len(gram), dtype=np.uint64)  # ties: the leftmost
        w = 1
        while 2 * w <= window:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        least = np.minimum(least[:n], least[window - w : window - w + n])
        anchor = (least & LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor))
        lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [n - 1]])
        at = anchor[lo]
        hull = (s[hi + length] - s[lo]) * inverse[lo]
        shape = ((at - hi) * 256 + (at - lo)).astype(np.uint64)
        found.append((gram[at], mix(hull + mix(shape)), at + begin, lo + begin, hi + begin))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=t) for t in ("u8", "u8", "i8", "i8", "i8"))


def bytes_of(column) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode(), dtype=np.uint8) for t in column.to_pylist()]


def sampled(docs: DataFrame, length: int) -> DataFrame:
    """A row for each node: gram, hull, doc, place (anchor, and how far before it the last and first start are)."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                docs_, parts, held = [], [], 0
                for doc, data in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                    if len(data) < length:
                        continue
                    gram, hull, at, lo, hi = nodes_of(data, length)
                    parts.append((gram.view(np.int64), hull.view(np.int64), (at << 16) | ((at - hi) << 8) | (at - lo)))
                    docs_.append(np.full(len(at), doc, dtype=np.int64))
                    held += len(at)
                    if held > 500_000:
                        yield batch_of(parts, docs_)
                        docs_, parts, held = [], [], 0
                if parts:
                    yield batch_of(parts, docs_)

    def batch_of(parts, docs_):
        gram, hull, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(hull), pa.array(np.concatenate(docs_)), pa.array(place)], ["gram", "hull", "doc", "place"])

    return docs.select("doc", "text").mapInArrow(run, "gram long, hull long, doc long, place long")


def packed(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes: less to shuffle."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc", "z"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, z binary")


CONTEXT = "gram long, doc long, place long, weight int, context binary"


def with_context(texts: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """The nodes (gram, doc, place, weight) with the bytes under their strings, from packed() texts."""
    wanted = nodes.groupBy("doc").agg(F.collect_list(F.struct("gram", "place", "weight")).alias("nodes"))  # as many as fit one text

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows, size = ([], [], [], [], []), 0
            for doc, z, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = press.decompress(z)
                for node in nodes:
                    at, near, far = node["place"] >> 16, node["place"] >> 8 & 255, node["place"] & 255
                    for column, x in zip(rows, (node["gram"], doc, node["place"], node["weight"], data[at - far : at - near + length]), strict=True):
                        column.append(x)
                size += len(nodes)
                if size > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["gram", "doc", "place", "weight", "context"])
                    rows, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["gram", "doc", "place", "weight", "context"])

    return texts.join(wanted, "doc").mapInArrow(run, CONTEXT)


def starts_of(rows: dict[str, list], length: int):
    """For some nodes, all their starts: class (of gram and place in the string), node number, start in the text,
    and a function that gives the fingerprints of the next h bytes, h doubling."""
    place = np.array(rows["place"], dtype=np.int64)
    at, near, far = place >> 16, place >> 8 & 255, place & 255
    sizes = np.array([len(c) for c in rows["context"]])
    data = np.frombuffer(b"".join(rows["context"]), dtype=np.uint8)
    counts = far - near + 1
    node = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = np.repeat(np.cumsum(sizes) - sizes, counts) + step
    gram = np.array(rows["gram"], dtype=np.int64).view(np.uint64)
    kind = mix(gram[node] + mix((far[node] - step).astype(np.uint64)))
    s, inverse = sums(data), both_powers(len(data) + 1)[1]

    def first(h):
        return (s[h:] - s[:-h]) * inverse[: len(data) - h + 1]

    def double(rank, h):
        """Ranks of 2h bytes from the pairs (rank of h bytes, rank of the h bytes behind them)."""
        return rank[:-h] + rank[h:] * np.uint64(pow(BASE, h, 2**64))

    return kind, node, at[node] - far[node] + step, spot, first, double


def repeated_starts(rows: dict[str, list], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Node number and start of the nodes' repeated strings, found by prefix doubling."""
    kind, node, start, spot, first, double = starts_of(rows, length)
    weight = np.array(rows["weight"], dtype=np.int64)
    h = length
    while h % 2 == 0 and h > GRAM // 2:
        h //= 2
    rank = first(h)
    while True:
        _, of = np.unique(mix(kind + rank[spot]), return_inverse=True)
        keep = np.bincount(of, weight[node])[of] >= 2  # unique ones drop out
        kind, node, start, spot = kind[keep], node[keep], start[keep], spot[keep]
        if h == length or not len(node):
            return node, start
        rank, h = double(rank, h), 2 * h


def runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in a row as (doc, first, last)."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(doc) != 0)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], start[end]


RUN = "doc long, lo long, hi long"


def doubled(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts (doc, lo, hi) among nodes whose gram has at most HOT of them: sorted by gram, so
    that a task sees a gram's nodes together."""

    def solve(rows):
        node, start = repeated_starts(rows, length)
        open_ = np.array(rows["weight"])[node] == 1  # the others are known to be repeated
        doc, lo, hi = runs(np.array(rows["doc"], dtype=np.int64)[node[open_]], start[open_])
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi)], ["doc", "lo", "hi"])

    def run(batches):
        with np.errstate(over="ignore"):
            held: dict[str, list] = {}
            for batch in slices(batches):
                new = batch.to_pydict()
                held = {k: held.get(k, []) + v for k, v in new.items()}
                whole = len(held["gram"])
                while whole and held["gram"][whole - 1] == held["gram"][-1]:
                    whole -= 1  # the last gram may go on
                if whole > 8000:
                    yield solve({k: v[:whole] for k, v in held.items()})
                    held = {k: v[whole:] for k, v in held.items()}
            if held and held["gram"]:
                yield solve(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, RUN)


def counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with more nodes: every start is a row, counted by Spark with pre-aggregation."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                for i in range(0, batch.num_rows, 4000):
                    rows = batch.slice(i, 4000).to_pydict()
                    kind, node, start, spot, first, _ = starts_of(rows, length)
                    get = lambda name, node=node, rows=rows: pa.array(np.array(rows[name], dtype=np.int64)[node])
                    yield pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), pa.array(first(length)[spot].view(np.int64)), get("doc"), pa.array(start), get("weight")], ["kind", "rank", "doc", "lo", "weight"])

    starts = contexts.mapInArrow(run, "kind long, rank long, doc long, lo long, weight long")
    twice = starts.groupBy("kind", "rank").agg(F.sum("weight").alias("n")).filter("n > 1").select("kind", "rank")
    return starts.filter("weight = 1").join(twice, ["kind", "rank"]).select("doc", "lo", F.col("lo").alias("hi"))


def repeated_runs(docs: DataFrame, texts: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(doc, lo, hi): runs of starts of repeated strings, from docs (doc, text) with distinct docs and their packed() texts.

    What is counted by gram or hull is stored before it is joined back, so that the joins have nothing but exchanges
    below them and Spark can split a hot gram."""
    nodes = stored(sampled(docs, length))
    grams = stored(nodes.groupBy("gram").count().filter("count > 1").select("gram"))
    shared = stored(nodes.join(grams, "gram"))
    dropped(nodes, grams)
    kinds = stored(shared.groupBy("gram", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("one")))
    whole = shared.join(kinds.filter("n > 1").select("gram", "hull"), ["gram", "hull"])
    place = F.col("place")
    whole = whole.select("doc", (F.shiftright(place, 16) - place.bitwiseAND(255)).alias("lo"), (F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(255)).alias("hi"))
    several = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    ends = kinds.join(several, "gram").select("gram", "one.doc", "one.place", F.least("n", F.lit(2)).cast("int").alias("weight"), "kinds")
    usual = doubled(with_context(texts, ends.filter(F.col("kinds") <= hot), length), length)
    found = whole.unionByName(usual)
    if several.filter(F.col("kinds") > hot).limit(1).count():
        found = found.unionByName(counted(stored(with_context(texts, ends.filter(F.col("kinds") > hot), length)), length))
    return found


@in_small_batches
def removed_spans(docs: DataFrame, length: int = 200, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, what is left of its text without all bytes under a `length`-byte string that also starts
    elsewhere: id_col, _n_bytes, _spans (maximal removed runs as [start, end)), _kept (binary).

    Strings are judged on the input; matches do not cross documents. One row per row of `docs`, null ids and
    repeated rows included (copies of a row repeat each other); a null text is empty. Other columns are not read."""
    if length < 2 * GRAM or length - GRAM > 254:
        raise ValueError(f"length must be from {2 * GRAM} to {GRAM + 254}")
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    plain = dict(rows.dtypes)["_id"] == "bigint" and not rows.groupBy("_id").count().filter("count > 1 OR _id IS NULL").limit(1).count()
    # rows that their id does not tell apart get numbers, written once
    keyed = rows.withColumn("doc", F.col("_id")) if plain else stored(rows.withColumn("doc", F.monotonically_increasing_id()))
    texts = stored(packed(keyed.select("doc", "text")))
    spans = repeated_runs(keyed.select("doc", "text"), texts, length, hot).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            sizes, cuts, kept = [], [], []
            for z, found in zip(batch.column("z").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data, merged = press.decompress(z), []
                for lo, hi in sorted((r["lo"], r["hi"] + length) for r in found or []):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                edges = [0, *(x for m in merged for x in m), len(data)]
                sizes.append(len(data))
                cuts.append(merged)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(cuts, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc", "_n_bytes", "_spans", "_kept"])

    done = texts.join(spans, "doc", "left").select("doc", "z", "runs").mapInArrow(run, "doc long, _n_bytes long, _spans array<array<long>>, _kept binary")
    if plain:
        return done.withColumnRenamed("doc", id_col)
    return done.join(keyed.select("doc", F.col("_id").alias(id_col)), "doc").select(id_col, "_n_bytes", "_spans", "_kept")


