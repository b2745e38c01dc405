"""Ranked lexical search over a two-level quantised index.

Documents stand in segments of bounded size, each with its own inverted lists. The first level of a list holds places and
byte impacts: what a term adds to a document's score, but for the term's weight, in steps of the list, rounded up.
Weights times steps times bytes bound a score from above, and by less than a step for each term from below. Bounds of all
items over a segment's documents come in one pass of the lists; a document goes on while its upper bound reaches
the k-th best lower bound that is known. What reaches the k-th lower bound of all documents is scored again in whole
numbers from the second level, the term frequencies, so the result is exact.

Terms are runs of digits, A-Z, a-z and characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import dropped, in_small_batches, quoted, slices, stored, worker_cache
from webloom.llm.decontaminate import words

#: Bytes of text, and documents, of a segment: a task holds one at a time.
SEGMENT_BYTES, SEGMENT_DOCS = 8_000_000, 50_000
#: Pairs of item and term that are broadcast at once, about 30 MB; more items are asked in several passes.
MAX_PAIRS = 500_000

_PLAIN = bytes(c + 32 if chr(c) in string.ascii_uppercase else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def length_norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of so many terms: 50 + (50 size n_docs) div n_terms."""
    if 50 * int(sizes.max(initial=0)) * n_docs >= 2**63:
        sizes = sizes.astype(object)
    return (50 + (50 * sizes * n_docs) // max(1, n_terms)).astype(np.int64)


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term adds, for a weight of one: at most 1,000,000."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norms)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _rows_of(segment: str, ids: list, sizes: list[int], known: dict[bytes, int], numbers: list[np.ndarray], tfs: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A segment's lists by term, behind a row of its documents."""
    names = sorted(known)
    place = np.empty(len(names), dtype=np.int64)
    place[[known[t] for t in names]] = np.arange(len(names))
    none = np.zeros(0, dtype=np.int64)
    number, tf = place[np.concatenate([none, *numbers])], np.concatenate([none, *tfs])
    at = np.repeat(np.arange(len(ids)), [len(x) for x in numbers])
    order = np.argsort(number, kind="stable")
    number, tf, at = number[order], tf[order], at[order]
    size = np.bincount(number, minlength=len(names))
    start = np.cumsum(size) - size
    exact = impacts(tf, length_norms(np.array(sizes, dtype=np.int64), n_docs, n_terms)[at])
    step = -(-np.maximum.reduceat(exact, start) // 255) if len(names) else none
    quantised = -(-exact // np.maximum(step, 1)[number])

    def lists(values, dtype):
        ends = (np.append(start, len(values)) * np.dtype(dtype).itemsize).astype(np.int32)
        return pa.concat_arrays([pa.nulls(1, pa.binary()), pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype(dtype).tobytes())])])

    first = lambda x, t: pa.concat_arrays([pa.array([x], t), pa.nulls(len(names), t)])
    rest = lambda x, t: pa.concat_arrays([pa.nulls(1, t), pa.array(x, t)])
    columns = [
        pa.array([segment] * (len(names) + 1)), pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(names, pa.binary()).cast(pa.string())]), rest(size, pa.int64()), rest(step, pa.int64()),
        lists(at, np.int32), lists(quantised, np.uint8), lists(tf, np.int32), first(ids, pa.list_(pa.int64())), first(sizes, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["segment", "term", "df", "step", "at", "impacts", "tf", "ids", "sizes"])


@dataclass
class RankedIndex:
    """`lists` (segment, term, df, step, at, impacts, tf; a row of null term holds the segment's ids and sizes), a stored
    table; n_docs documents with a term, n_terms of these with repeats."""

    lists: DataFrame
    n_docs: int
    n_terms: int

    @staticmethod
    @in_small_batches
    def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> RankedIndex:
        """The index of every row of `docs`, whole texts with all their terms; null and empty texts have none. Ids are whole
        numbers or null; rows of equal ids are documents of their own."""
        texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text"))

        def count(batches):
            for batch in slices(batches):
                sizes = [len(terms(t)) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], ["docs", "terms"])

        sums = texts.select("text").mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        n_docs, n_terms = int(sums[0]), int(sums[1])

        def run(batches):
            worker_cache("ranked lists", dict)
            part, k = TaskContext.get().partitionId(), 0
            ids, sizes, known, numbers, tfs, held = [], [], {}, [], [], 0
            for batch in slices(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if ids and (held + len(text) > segment_bytes or len(ids) >= segment_docs):
                        yield _rows_of(f"{part:06d}-{k:06d}", ids, sizes, known, numbers, tfs, n_docs, n_terms)
                        ids, sizes, known, numbers, tfs, held, k = [], [], {}, [], [], 0, k + 1
                    found = Counter(terms(text))
                    ids.append(doc_id)
                    sizes.append(sum(found.values()))
                    numbers.append(np.array([known.setdefault(t, len(known)) for t in found], dtype=np.int64))
                    tfs.append(np.array(list(found.values()), dtype=np.int64))
                    held += len(text)
            if ids:
                yield _rows_of(f"{part:06d}-{k:06d}", ids, sizes, known, numbers, tfs, n_docs, n_terms)

        schema = "segment string, term string, df long, step long, at binary, impacts binary, tf binary, ids array<long>, sizes array<long>"
        return RankedIndex(stored(texts.mapInArrow(run, schema)), n_docs, n_terms)

    def search(self, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
        """(item, rank, doc_id, score), a stored table: of each item the `k` documents of highest score above 0, of equals those of
        least doc_id. Items without terms have no rows; rows of one id are one item."""
        asked = stored(items.select(F.col(quoted(id_col)).alias("item"), F.explode(F.array_distinct(words(F.col(quoted(text_col))))).alias("term")).distinct())
        passes = max(1, -(-asked.count() // max_pairs))
        found = [self._asked(asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p) if passes > 1 else asked, k) for p in range(passes)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        out = stored(out)
        dropped(asked)
        return out

    def _asked(self, pairs: DataFrame, k: int) -> DataFrame:
        spark = pairs.sparkSession
        # the pairs of a pass are bounded: they go to the driver and to every worker
        local = pairs.toArrow()
        items = sorted(set(local.column("item").to_pylist()), key=lambda x: (x is not None, x))
        vocabulary = sorted(set(local.column("term").to_pylist()))
        item_at, term_at = {x: i for i, x in enumerate(items)}, {t: i for i, t in enumerate(vocabulary)}
        by_item: list[list[int]] = [[] for _ in items]
        for item, term in zip(local.column("item").to_pylist(), local.column("term").to_pylist(), strict=True):
            by_item[item_at[item]].append(term_at[term])
        numbered = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string()), "t": pa.array(range(len(vocabulary)), pa.int32())}), "term string, t int")
        lists = stored(self.lists.filter(F.col("term").isNotNull()).join(F.broadcast(numbered), "term").select("segment", "t", "df", "step", "at", "impacts", "tf"))
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for t, df in lists.groupBy("t").agg(F.sum("df")).collect():  # a row a term of the pass
            weights[t] = weight(self.n_docs, df)
        held = spark.sparkContext.broadcast((by_item, weights))
        survivors = stored(_bounded(lists, held, k))
        best = Window.partitionBy("item").orderBy(F.desc("lower"))
        least = survivors.select("item", "lower", F.row_number().over(best).alias("r")).filter(F.col("r") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("least"))
        reached = survivors.join(F.broadcast(least), "item").filter(F.col("upper") >= F.col("least"))  # a row an item
        docs = self.lists.filter(F.col("term").isNull()).select("segment", "ids", "sizes")
        known = reached.join(docs, "segment").select("segment", "item", "at", F.expr("get(ids, at)").alias("doc_id"), F.expr("get(sizes, at)").alias("size"))
        exact = stored(_rescored(known, lists, held, self.n_docs, self.n_terms).filter(F.col("score") > 0))
        dropped(survivors, lists)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int32()), "name": pa.array(items, local.column("item").type)}))
        ranked = exact.withColumn("rank", rank).filter(F.col("rank") <= k)
        return ranked.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "doc_id", "score")


def segments_of(batches):
    """Rows of a sorted partition, segment by segment: (segment, {column: list})."""
    name, rows = None, {}
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, segment in enumerate(columns["segment"]):
            if segment != name:
                if rows:
                    yield name, rows
                name, rows = segment, {n: [] for n in columns}
            for n, x in columns.items():
                rows[n].append(x[i])
    if rows:
        yield name, rows


def _bounded(lists: DataFrame, held, k: int) -> DataFrame:
    """(item, segment, at, upper, lower): documents whose upper bound reaches the k-th best lower bound that the task has met,
    among them those that reach that of all documents."""

    def run(batches):
        worker_cache("ranked bounds", dict)
        by_item, weights = held.value
        best = [np.zeros(0, dtype=np.int64) for _ in by_item]
        for segment, rows in segments_of(batches):
            own, n, out = {}, 0, []
            for t, step, at, bytes_ in zip(rows["t"], rows["step"], rows["at"], rows["impacts"], strict=True):
                places, unit = np.frombuffer(at, dtype=np.int32), int(weights[t]) * step
                if unit:
                    own[t] = places, unit, np.frombuffer(bytes_, dtype=np.uint8) * np.int64(unit)
                    n = max(n, int(places[-1]) + 1)
            for item, wanted in enumerate(by_item):
                here = [own[t] for t in wanted if t in own]
                if not here:
                    continue
                upper = np.zeros(n, dtype=np.int64)
                for places, _, bound in here:
                    upper[places] += bound
                slack = sum(unit for _, unit, _ in here)
                some = np.flatnonzero(upper)
                top = upper[some]
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
                lower = np.sort(np.concatenate([best[item], top - slack]))[-k:]
                best[item] = lower
                some = some[upper[some] >= lower[0]] if len(lower) == k else some
                if len(some):
                    out.append((item, some, upper[some], upper[some] - slack))
            if out:
                columns = [np.concatenate([np.full(len(s), item) for item, s, _, _ in out]).astype(np.int32), *(np.concatenate([x[i] for x in out]) for i in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array([segment] * len(columns[0])), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3])], ["item", "segment", "at", "upper", "lower"])

    level = lists.select("segment", "t", "step", "at", "impacts").repartition("segment").sortWithinPartitions("segment")
    return level.mapInArrow(run, "item int, segment string, at int, upper long, lower long")


def _rescored(known: DataFrame, lists: DataFrame, held, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): exact scores of (segment, item, at, doc_id, size)."""

    def run(key, documents: pa.Table, level: pa.Table) -> pa.Table:
        by_item, weights = held.value
        tf_of = {t: (np.frombuffer(a, dtype=np.int32), np.frombuffer(f, dtype=np.int32)) for t, a, f in zip(level.column("t").to_pylist(), level.column("at").to_pylist(), level.column("tf").to_pylist(), strict=True)}
        item, at = documents.column("item").to_numpy(), documents.column("at").to_numpy()
        norms = length_norms(documents.column("size").to_numpy().astype(np.int64), n_docs, n_terms)
        score = np.zeros(len(item), dtype=np.int64)
        for one in np.unique(item):
            rows = np.flatnonzero(item == one)
            for t in by_item[one]:
                if t in tf_of:
                    places, tfs = tf_of[t]
                    found = np.minimum(np.searchsorted(places, at[rows]), len(places) - 1)
                    there = places[found] == at[rows]
                    some = rows[there]
                    score[some] += weights[t] * impacts(tfs[found[there]].astype(np.int64), norms[some])
        return pa.table({"item": pa.array(item.astype(np.int32)), "doc_id": documents.column("doc_id").cast(pa.int64()), "score": pa.array(score)})

    level = lists.select("segment", "t", "at", "tf")
    return known.groupBy("segment").cogroup(level.groupBy("segment")).applyInArrow(run, "item int, doc_id long, score long")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, coalesce(sum(len(w)), 0) AS total FROM d),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
q AS (SELECT t, CAST(floor(1000 * ln((2 * s.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE t IN (SELECT t FROM b) GROUP BY t, s.docs),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * s.docs) // s.total AS BIGINT))))) AS BIGINT) AS score FROM b JOIN q USING (t) JOIN p USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
