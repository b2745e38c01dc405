"""What two leaders of a band's group leave open: exact pairs by prefixes of rare elements.

Sets are distinct unsigned 64-bit numbers. Their elements are ordered by how often they occur (counted in hashed
buckets, of which any total order would do), the rarest first. If two sets have a Jaccard similarity of t or more, the
first 1 - t of the longer and the first 1 - 2t / (1 + t) of the shorter share an element, and at the first that they
share enough is left in both for the overlap that t asks for; 256 bits of each set bound the overlap once more. So no pair is lost, and what a family shares (its template)
stands at the end of every set, where nothing is joined, unless the family is alike as a whole. More bits tell more pairs
that are almost similar apart before their sets are read, and make the postings longer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, run_once, slices, stored

#: Buckets in which elements are counted: a bound on memory; collisions change the order, not the pairs.
BUCKETS = 1 << 20
EPS = 1e-9


def open_nodes(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label) of the nodes that share a group of three or more (see near_dedup.shared_groups) with a node of another
    label: pairs of which leaders may not have been compared. Without labels, of all nodes in such groups. A node
    without a label is its own."""
    own = F.coalesce("label", "node") if labels is not None else F.col("node")
    many = groups.filter("n > 2").select("band", "key", "node")
    joined = many.join(labels, "node", "left") if labels is not None else many
    keyed = stored(joined.select("node", own.alias("label"), "band", "key"))
    mixed = stored(keyed.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band", "key"))
    found = stored(keyed.join(mixed, ["band", "key"]).select("node", "label").distinct())
    dropped(keyed, mixed)
    return found


def bits_of(x: np.ndarray, n: int = 256) -> np.ndarray:
    """n bits of a set, a power of two from 64 on, as n / 64 numbers: each element sets one."""
    bits = np.zeros(n, dtype=np.uint8)
    bits[(x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - n.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def counted(sets: DataFrame) -> np.ndarray:
    """In how many sets the elements of each bucket occur."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches):
            for s in batch.column(0):
                at = (np.frombuffer(s.as_py(), dtype=np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
                np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["bucket", "n"])

    found = sets.select("set").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def close_pairs(sets: DataFrame, threshold: float, n_bits: int = 256, earlier: int = 0) -> DataFrame:
    """Pairs (a, b) of nodes of different labels among `sets` (node, label, set) that may reach the threshold: all that
    do are among them.

    A pair meets at every element that its prefixes share. With `earlier`, the first so many elements before its own go along
    with each, so that a pair meets at the first one only, which is enough: whatever rules it out there does so later."""
    bits = [f"b{i}" for i in range(n_bits // 64)]
    held = sets.sparkSession.sparkContext.broadcast(counted(sets))

    def run(batches):
        often = held.value
        for batch in slices(batches):
            out, before = [[] for _ in range(6 + len(bits))], []
            for node, label, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(s, dtype=np.uint64)
                n = often[(x % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((x, n))[: len(x) - int(np.ceil(threshold * len(x) - EPS)) + 1]
                at = np.flatnonzero(n[order] > 1)  # what occurs once meets nothing
                if earlier:
                    rare = x[order[at]].view(np.int64)
                    before += [rare[: min(k, earlier)] for k in range(len(at))]
                short = len(x) - int(np.ceil(2 * threshold / (1 + threshold) * len(x) - EPS)) + 1
                for o, v in zip(out, (x[order[at]].view(np.int64), np.full(len(at), node), np.full(len(at), label), np.full(len(at), len(x)), at, at < short, *(np.full(len(at), b) for b in bits_of(x, n_bits))), strict=True):
                    o.append(v)
            names = ["token", "node", "label", "size", "at", "short", *bits]
            if out[0]:
                columns = [pa.array(np.concatenate(o)) for o in out]
                if earlier:
                    ends = np.cumsum([0, *map(len, before)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *before]))))
                yield pa.RecordBatch.from_arrays(columns, names + ["before"] * (earlier > 0))

    postings = stored(sets.select("node", "label", "set").mapInArrow(run, "token long, node long, label long, size long, at long, short boolean, " + ", ".join(f"{b} long" for b in bits) + ", before array<long>" * (earlier > 0)))
    carried = ["node", "label", "size", "at", *bits] + ["before"] * (earlier > 0)
    x = postings.filter("short").select("token", *[F.col(c).alias(f"x_{c}") for c in carried])
    y = postings.select("token", *[F.col(c).alias(f"y_{c}") for c in carried])
    met = x.join(y, "token").filter("x_label <> y_label AND (x_size < y_size OR x_size = y_size AND x_node < y_node)")
    need = F.lit(threshold / (1 + threshold)) * (F.col("x_size") + F.col("y_size")) - EPS
    left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    # an element of one set alone accounts for every bit that differs
    differ = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits), F.lit(0))
    left = F.least(left, (F.col("x_size") + F.col("y_size") - differ) / 2)
    met = met.filter((F.col("x_size") >= F.lit(threshold) * F.col("y_size") - EPS) & (left >= need))
    if earlier:
        met = met.filter(~F.arrays_overlap("x_before", "y_before"))
    found = stored(met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    dropped(postings)
    return found


def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(x, y, strict=True):
        a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(common / (len(a) + len(b) - common))
    return pd.Series(out, dtype="float64")


def links_between(sets: DataFrame, threshold: float, n_bits: int = 256, earlier: int = 0) -> DataFrame:
    """(a, b, similarity) of all nodes of different labels among `sets` (node, label, set), compared exactly."""
    pairs = close_pairs(sets, threshold, n_bits, earlier)
    exact = run_once(jaccard, "double")
    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("set").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    found = stored(both.select("a", "b", exact("x", "y").alias("similarity")).filter(F.col("similarity") >= threshold))
    dropped(pairs)
    return found
