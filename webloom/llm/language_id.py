"""Language ID by prediction by partial matching over bytes.

For each language a context tree of the last one to three bytes holds symbol counts; a symbol that a context
has not seen costs an escape (method C: distinct symbols over total plus distinct symbols) and is sought in
the next shorter context without the symbols already excluded, at last among all bytes alike. Statistics are
frozen after training, so the code length of a byte depends on its context and itself only.

What a longer context has seen its suffix has seen too, so the symbols excluded in a context are those of the next
longer one, and their share of its counts is one number for each longer context. Code lengths are thus looked up: the
lengths of all byte 4-grams of the training texts are laid out in a table with a column for each language; those of
other 4-grams are computed from the counts, by the same formula."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import BATCH_ROWS, columns_of, fresh, in_small_batches, least_hashed, quoted, run_once, worker_cache

ORDER = 3
#: What stands before a text.
LEAD = b"\n" * ORDER
#: Languages that share a table, so that the model's size follows the languages, not their square.
BLOCK = 8
#: Rows of a key table up to which it is broadcast.
BROADCAST_KEYS = 200_000


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class ContextTree:
    """One language's counts by order: symbols in contexts, and for each context its total, its distinct symbols and
    what their counts amount to in the next shorter context."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.orders = []
        for order in range(ORDER + 1):
            code, of = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(of, n)
            context, of = np.unique(code >> 8, return_inverse=True)
            shadow = np.zeros(len(context))
            if order:
                shorter, shorter_count = self.orders[-1][:2]
                shadow = np.bincount(of, shorter_count[np.searchsorted(shorter, code & ((1 << 8 * order) - 1))])
            self.orders.append((code, count, context, np.bincount(of, count), np.bincount(of).astype(float), shadow))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each 4-gram after the other three."""
        out, left = np.zeros(len(gram)), np.ones(len(gram), dtype=bool)
        shadow, kinds = np.zeros(len(gram)), np.zeros(len(gram))
        for order in range(ORDER, -1, -1):
            code, count, context, totals, distinct, shadows = self.orders[order]
            own = gram & ((1 << 8 * (order + 1)) - 1)
            at, there = find(context, own >> 8)
            new = np.where(there, distinct[at], 0) - kinds  # symbols not excluded
            whole = np.where(there, totals[at], 0) - shadow + new
            at_code, hit = find(code, own)
            hit &= left
            out[hit] -= np.log2(count[at_code[hit]] / whole[hit])
            left &= ~hit
            escapes = left & (new > 0)
            out[escapes] -= np.log2(new[escapes] / whole[escapes])
            shadow, kinds = np.where(there, shadows[at], 0), np.where(there, distinct[at], 0)
        out[left] += np.log2(256 - kinds[left])  # all bytes that the language has not
        return out


class Table:
    """Code lengths under some languages of all 4-grams that one of them has seen."""

    def __init__(self, trees: list[ContextTree]):
        self.trees = trees
        self.grams = np.unique(np.concatenate([t.orders[ORDER][0] for t in trees]))
        self.cost = self.computed(self.grams).astype(np.float32)
        # places by hash, the last one of those that share a slot
        self.shift = np.uint32(32 - max(1, int(2 * len(self.grams)).bit_length()))
        self.places = np.zeros(1 << (32 - int(self.shift)), dtype=np.int32)
        self.places[self.slots(self.grams)] = np.arange(len(self.grams))

    def slots(self, gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (gram.astype(np.uint32) * np.uint32(0x9E3779B1)) >> self.shift

    def computed(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(gram) for t in self.trees], axis=1)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        at = self.places[self.slots(gram)]
        other = np.flatnonzero(self.grams[at] != gram)
        at[other], there = find(self.grams, gram[other])
        out = self.cost[at]
        if not there.all():
            other = other[~there]
            unseen, of = np.unique(gram[other], return_inverse=True)
            out[other] = self.computed(unseen)[of]
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    tables: list[Table]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        data = np.frombuffer(b"".join([LEAD + t for t in texts]), dtype=np.uint8).astype(np.int64)
        size = np.array([len(t) for t in texts])
        gram = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        cost = np.hstack([t.bits(gram) for t in self.tables])
        cost = np.vstack([cost, np.zeros((1, len(self.languages)), np.float32)])
        start = np.cumsum(size + ORDER) - size - ORDER
        both = np.stack([start, start + size], axis=1).ravel()  # a text's bytes, then the lead of the next one
        return np.where(size[:, None] > 0, np.add.reduceat(cost, both, axis=0, dtype=np.float64)[::2], 0)


def text_hash(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def bounded_sample(docs: DataFrame, max_docs: int, max_total: int) -> DataFrame:
    """(lang, text): of each language at most `max_docs` distinct texts, those of least hash, and about `max_total` in all."""
    keyed = docs.select(F.col("lang").cast("string").alias("label"), text_hash(F.col("text")).alias("h"), "text")
    chosen = least_hashed(keyed.select("label", "h").distinct(), max_docs, max_total)
    chosen = F.broadcast(chosen) if max_total <= BROADCAST_KEYS else chosen
    return keyed.join(chosen, ["label", "h"]).dropDuplicates(["label", "h"]).select(F.col("label").alias("lang"), "text")


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of byte 4-grams; a gram is 32 bits, its last byte the lowest."""

    def run(frames):
        for frame in frames:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                b = np.frombuffer(LEAD + text.encode(), dtype=np.uint8).astype(np.int64)
                held.setdefault(lang, []).append(((b[:-3] * 256 + b[1:-2]) * 256 + b[2:-1]) * 256 + b[3:])
            for lang, grams in held.items():  # each batch is counted by itself: bounded memory
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n.astype(np.int64)})

    return sample.select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_model(counts: pd.DataFrame) -> LanguageModel:
    """The frozen model from (lang, gram, n)."""
    languages = sorted(counts["lang"].unique())
    tables = []
    for start in range(0, len(languages), BLOCK):
        own = [counts[counts["lang"] == x] for x in languages[start : start + BLOCK]]
        tables.append(Table([ContextTree(c["gram"].to_numpy(), c["n"].to_numpy().astype(np.float64)) for c in own]))
    return LanguageModel(languages, tables)


@in_small_batches
def fit(docs: DataFrame, max_docs: int = 1500, max_total: int = 60_000) -> LanguageModel | None:
    """A model from rows (text, lang): of those with both, at most `max_docs` distinct texts of each language and about
    `max_total` in all; None where there are none. What reaches the driver is bounded by that sample. A language whose
    texts are all empty is not learned."""
    labelled = docs.filter((F.col("text") != "") & F.col("lang").isNotNull()).select("text", "lang")
    counts = gram_counts(bounded_sample(labelled, max_docs, max_total)).toPandas()
    return build_model(counts) if len(counts) else None


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """`docs` with, last, _lang, _score (the language's posterior probability) and _bits (bits per byte under it); where
    `docs` has a column of that name, ours has more underscores behind.

    A text that is null or has no letter is `und` with score 0 and null bits, as is every text where there
    is no model. Ties go to the first language in alphabetical order. Whole texts are read."""
    lang, score_, bits_, found = fresh(docs.columns, "_lang", "_score", "_bits", "_found")
    if model is None:
        return docs.select(*columns_of(docs), F.lit("und").alias(lang), F.lit(0.0).alias(score_), F.lit(None).cast("double").alias(bits_))
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def score(texts: pa.Array) -> pa.Array:
        worker_cache("language", dict)  # lets go of another operator's
        model, rows = held.value, []
        chunk, size = [], 0

        def flush():
            if chunk:
                bits = model.bits(chunk)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1, keepdims=True)
                p = 1 / np.exp2(-np.minimum(bits - least, 500)).sum(axis=1)
                rows.extend((model.languages[b], float(x), float(v[0]) / max(1, len(t))) for b, x, v, t in zip(best, p, least, chunk, strict=True))
                chunk.clear()

        for start in range(0, len(texts), BATCH_ROWS):
            for t in texts.slice(start, BATCH_ROWS).to_pylist():
                b = (t or "").encode()
                if size + len(b) > 100_000:
                    flush()
                    size = 0
                chunk.append(b)
                size += len(b)
        flush()
        types = {"lang": pa.string(), "score": pa.float64(), "bits": pa.float64()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

    udf = run_once(score, "lang string, score double, bits double", F.arrow_udf)
    text = F.col(quoted(text_col))
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(*columns_of(docs), udf(text).alias(found)).withColumn(found, F.when(letters, F.col(found)).otherwise(und))
    return scored.select(*columns_of(docs), F.col(f"{found}.lang").alias(lang), F.col(f"{found}.score").alias(score_), F.col(f"{found}.bits").alias(bits_))
