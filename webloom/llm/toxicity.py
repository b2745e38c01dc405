"""Toxicity by a factorization machine over hashed terms: a bias, a weight for each term and, for each pair
of terms, the product of their factors."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import BATCH_ROWS, columns_of, fresh, in_small_batches, least_hashed, quoted, stored, worker_cache

TERM = re.compile(r"[^\W\d_]+")
#: Words of which a worker remembers the bucket; a bound on memory, not on results. Longer ones are not remembered.
CACHE_WORDS, LONG = 200_000, 64
#: Rows of the sample's key table up to which it is broadcast.
BROADCAST_KEYS = 200_000


def buckets_of(texts, buckets: int) -> list[np.ndarray]:
    """For each text the sorted distinct buckets of its terms."""
    known = worker_cache(("terms", buckets), dict)
    out = []
    for text in texts:
        if len(known) > CACHE_WORDS:
            known.clear()
        found = set()
        for term in set(TERM.findall((text or "").lower())):
            at = known.get(term)
            if at is None:
                at = zlib.crc32(term.encode()) % buckets
                if len(term) < LONG and len(known) <= CACHE_WORDS:
                    known[term] = at
            found.add(at)
        out.append(np.array(sorted(found), dtype=np.int32))
    return out


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All features of some texts, and the number of the text that each belongs to."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return np.concatenate([np.zeros(0, dtype=np.int32), *rows]), np.repeat(np.arange(len(rows)), sizes)


def sums_by(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by `of`, which ascends."""
    out = np.zeros((n, *values.shape[1:]))
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class FactorizationMachine:
    """weight and factors of the buckets that the sample has, and a last row of zeros for all others; place gives each
    bucket's row."""

    buckets: int
    bias: float
    place: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def margins(self, texts) -> np.ndarray:
        rows = buckets_of(texts, self.buckets)
        at, who = flat(rows)
        at = self.place[at]
        v = self.factors[at].astype(np.float64)
        pairs = sums_by(v, who, len(rows)) ** 2 - sums_by(v**2, who, len(rows))
        return self.bias + sums_by(self.weight[at].astype(np.float64), who, len(rows)) + 0.5 * pairs.sum(axis=1)


def evidence(count: np.ndarray, positive: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of each term: in how far the share of positives among its documents is not that of all."""
    part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1) / expected), 0)
    return 2 * (part(positive, count * share) + part(count - positive, count * (1 - share)))


def train(rows: list[np.ndarray], labels: np.ndarray, buckets: int, factors: int = 8, epochs: int = 8, rate: float = 0.3, factor_rate: float = 0.05, weak: float = 0.2, strong: float = 100.0, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss with Gaussian priors, in batches of 128 documents, touching what a batch holds; the same
    for the same input.

    Every term is learned, by itself and in pairs. The priors' precision is `strong`, which a term of few documents does
    not overcome; for the weight of a term whose evidence is more than chance would give to one of all terms it is `weak`.
    A term that matters in pairs only has no evidence by itself, but the documents to overcome the prior."""
    rng = np.random.default_rng(seed)
    seen, count = np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *rows]), return_counts=True)
    rows = [np.searchsorted(seen, r).astype(np.int32) for r in rows]
    p = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    positive = np.bincount(flat([r for r, y in zip(rows, labels, strict=True) if y])[0], minlength=len(seen))
    prior = np.where(evidence(count, positive, p) > 2 * np.log(max(2, len(seen))), weak, strong)
    bias, w, v = float(np.log(p / (1 - p))), np.zeros(len(seen)), rng.normal(0, 0.02, (len(seen), factors)).astype(np.float32)
    gw, gv, gb = np.ones(len(seen)), np.ones((len(seen), factors), dtype=np.float32), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), 128):
            batch = order[start : start + 128]
            at, who = flat([rows[i] for i in batch])
            va = v[at]
            sums = sums_by(va, who, len(batch))
            z = bias + sums_by(w[at], who, len(batch)) + 0.5 * (sums**2 - sums_by(va**2, who, len(batch))).sum(axis=1)
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            gb += e.sum() ** 2
            bias -= rate * e.sum() / np.sqrt(gb)
            if not len(at):
                continue
            by_term = np.argsort(at, kind="stable")
            touched, of, here = np.unique(at[by_term], return_inverse=True, return_counts=True)
            share = here / count[touched]  # a term's prior counts once an epoch, however many batches it is in
            dw = sums_by(e[who][by_term], of, len(touched)) + prior[touched] * share * w[touched]
            dv = sums_by((e[who, None] * (sums[who] - va))[by_term], of, len(touched)) + strong * share[:, None] * v[touched]
            gw[touched] += dw**2
            gv[touched] += (dv**2).astype(np.float32)
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= (factor_rate * dv / np.sqrt(gv[touched])).astype(np.float32)
    place = np.full(buckets, len(seen), dtype=np.int32)
    place[seen] = np.arange(len(seen))
    return FactorizationMachine(buckets, bias, place, np.append(w, 0).astype(np.float32), np.vstack([v, np.zeros((1, factors), dtype=np.float32)]))


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, buckets: int = 2**20, factors: int = 8) -> FactorizationMachine | None:
    """From documents (doc_id, text) and labels (doc_id, label 0/1): of the labelled documents at most `max_docs`, those of
    least hash of the id; None without documents of both labels. Every term of the sample is learned, hashed to
    `buckets`. What reaches the driver are the sample's distinct buckets by document."""
    own = labels.filter(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("y"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    chosen = least_hashed(own.select(F.lit(0).alias("label"), "h").distinct(), max_docs)
    # the bounded list goes to the texts, which stay where they are
    wanted = stored(own.join(F.broadcast(chosen.select("h")), "h").groupBy("doc_id").agg(F.max("y").alias("label")))
    wanted = F.broadcast(wanted) if max_docs <= BROADCAST_KEYS else wanted
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(wanted, "doc_id")

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "features": buckets_of(frame["text"], buckets)})

    found = texts.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, features array<int>")
    # repeated rows of a document count once
    local = found.dropDuplicates(["doc_id", "features"]).toArrow().combine_chunks()
    y = local.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    lists = local.column("features").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    ids = local.column("doc_id").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (ids[i], zlib.crc32(rows[i].tobytes())))
    return train([rows[i] for i in order], y[order].astype(float), buckets, factors)


def score(docs: DataFrame, model: FactorizationMachine | None, text_col: str = "text") -> DataFrame:
    """`docs` with, last, _score: the probability of label 1; where `docs` has a column of that name, ours has more
    underscores behind. Null and empty texts have no terms and get the bias alone; without a model all scores
    are 0. Whole texts are read."""
    (name,) = fresh(docs.columns, "_score")
    if model is None:
        return docs.select(*columns_of(docs), F.lit(0.0).alias(name))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        z = np.concatenate([np.zeros(0), *(held.value.margins(texts.slice(i, BATCH_ROWS).to_pylist()) for i in range(0, len(texts), BATCH_ROWS))])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.select(*columns_of(docs), F.arrow_udf(run, "double")(F.col(quoted(text_col))).alias(name))
