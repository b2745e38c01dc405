"""Phrase collocations by Apriori passes: words, then phrases of two, three and four words.

Each pass knows the frequent phrases of the pass before, broadcast as sorted numbers, and emits a phrase of k words only
where both phrases of k-1 words in it are frequent. A frequent word is known by its place among all, a longer phrase
by its prefix's place and its last word's, so keys are exact. Texts are turned into such numbers once. A level that is too
large to be broadcast is counted by shuffle instead, phrases as strings, with the same result.

Cuts are scored, and phrases within longer ones dropped, by joins of the level tables."""

from __future__ import annotations

import string
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import dropped, in_small_batches, quoted, slices, stored, text_or_empty, worker_cache

# What ends a piece of text and what separates words.
PIECE_ENDS, BLANKS = ".,;:!?\n\v\f\r", " \t"
#: Frequent words, and frequent longer phrases, up to which a level is broadcast (some 150 and 64 MB in a worker).
MAX_WORDS_HELD, MAX_PHRASES_HELD = 1_000_000, 8_000_000
#: Distinct words, and keys, that a task counts before it hands them on: bounds on memory.
WORDS_HELD, KEYS_HELD = 200_000, 1_500_000
#: Rows of a group that is ranked at once.
RANKED_ROWS = 20_000

_PLAIN = bytes.maketrans((string.ascii_uppercase + PIECE_ENDS + BLANKS).encode(), (string.ascii_lowercase + "\n" * len(PIECE_ENDS) + " " * len(BLANKS)).encode())


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with a line end between pieces; empty strings stand among them and mean nothing."""
    return text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col(quoted(text_col))).cast("binary").alias("text"))


def word_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f): words in `min_count` places or more; with a null phrase all words of the language."""

    def rows(held):
        for lang, words in held.items():
            for nothing in (b"", b"\n"):
                words.pop(nothing, None)
            names = pa.array([*words, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), names, pa.array([*words.values(), sum(words.values())], pa.int64())], ["lang", "phrase", "f"])

    def run(batches):
        worker_cache("phrase words", dict)
        held: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from rows(held)
                held.clear()
        yield from rows(held)

    counted = texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.filter((F.col("f") >= min_count) | F.col("phrase").isNull())


def encoded(texts: DataFrame, words: pa.Table) -> DataFrame:
    """(ids): the texts as runs of 32-bit places in `words`; -1 stands for infrequent words and the ends of pieces and texts."""
    held = texts.sparkSession.sparkContext.broadcast((words.column("lang").to_pylist(), words.column("phrase").to_pylist()))
    token = uuid.uuid4().hex

    def make():
        out: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(zip(*held.value, strict=True)):
            out.setdefault(lang, {b"": -2})[word.encode()] = i
        return out

    def run(batches):
        known, out, size = worker_cache(("phrase ids", token), make), [], 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = known.get(lang)
                if place is None:
                    continue
                at = np.array([*(place.get(w, -1) for w in tokens(text)), -1], dtype=np.int32)
                out.append(at[at != -2])
                size += len(at)
                if size > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tobytes()], pa.binary())], ["ids"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tobytes()], pa.binary())], ["ids"])

    return texts.mapInArrow(run, "ids binary")


def places(ids: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each start the place of the frequent phrase of len(levels) + 1 words there among all such, or -1."""
    at = ids.astype(np.int64)
    for known in levels:
        keys = joined(at, ids)
        if not len(known) or not len(keys):
            return np.full(len(keys), -1)
        found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        at = np.where(known[found] == keys, found, -1)
    return at


def joined(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of phrases one word longer than those at `at`, -1 where one of the two phrases in them is infrequent."""
    last = ids[len(ids) - len(at) + 1 :].astype(np.int64)
    return np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] << 32 | last, -1)


def phrase_counts(runs: DataFrame, levels: list[np.ndarray], min_count: int) -> DataFrame:
    """(key, f): phrases one word longer than those of the last level, in `min_count` places or more."""
    held = runs.sparkSession.sparkContext.broadcast(levels)

    def batch_of(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "f"])

    def merged(keys, counts):
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(of, weights=np.concatenate(counts)).astype(np.int64)

    def run(batches):
        worker_cache("phrase keys", dict)
        keys, counts, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[i].as_buffer(), dtype=np.int32)
                found = joined(places(ids, held.value), ids)
                found = found[found >= 0]
                keys.append(found)
                counts.append(np.ones(len(found), dtype=np.int64))
                size += len(found)
                if size > KEYS_HELD:
                    k, n = merged(keys, counts)
                    keys, counts, size = [k], [n], len(k)
                    if size > KEYS_HELD // 2:
                        yield batch_of(k, n)
                        keys, counts, size = [], [], 0
        if keys:
            yield batch_of(*merged(keys, counts))

    return runs.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def spelt(level: DataFrame, words: pa.Table, levels: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, f) of a level table (key, f); `levels` are those below it."""
    held = level.sparkSession.sparkContext.broadcast((words.combine_chunks(), levels))

    def run(batches):
        words, levels = held.value
        for batch in batches:
            at, back = batch.column(0).to_numpy(), []
            for known in reversed(levels):
                back.append(at & 0xFFFFFFFF)
                at = known[at >> 32]
            order = [at >> 32, at & 0xFFFFFFFF, *reversed(back)]
            parts = [words.column("phrase").take(pa.array(x)).combine_chunks() for x in order]
            langs = words.column("lang").take(pa.array(order[0])).combine_chunks()
            yield pa.RecordBatch.from_arrays([langs, pc.binary_join_element_wise(*parts, " "), batch.column(1)], ["lang", "phrase", "f"])

    return level.mapInArrow(run, "lang string, phrase string, f long")


def windows_by_shuffle(texts: DataFrame, size: int, min_count: int) -> DataFrame:
    """(lang, phrase, f) of the frequent phrases of `size` words, all windows counted as strings: for levels too large to hold."""
    lower = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    pieces = texts.select("lang", F.explode(F.split(lower, "[.,;:!?\n-\r]", -1)).alias("piece"))
    words = pieces.select("lang", F.filter(F.split("piece", "[ \t]+", -1), lambda x: x != "").alias("w")).filter(F.size("w") >= size)
    each = words.select("lang", F.explode(F.expr(f"transform(sequence(0, size(w) - {size}), i -> array_join(slice(w, i + 1, {size}), ' '))")).alias("phrase"))
    return each.groupBy("lang", "phrase").agg(F.count("*").alias("f")).filter(F.col("f") >= min_count)


@in_small_batches
def frequent_phrases(docs: DataFrame, min_count: int = 30, max_words: int = 4, lang_col: str = "lang", text_col: str = "text", max_words_held: int = MAX_WORDS_HELD, max_phrases_held: int = MAX_PHRASES_HELD) -> DataFrame:
    """(lang, phrase, size, f), a stored table: every phrase of one to `max_words` words with f >= `min_count` occurrences in
    its language, overlapping ones included, none across pieces; and for each language with a word a row of size 0 and
    null phrase whose f counts its words. A null language is `und`; null texts are empty; repeated rows count again."""
    texts = _texts(docs, lang_col, text_col)
    first = stored(word_counts(texts, min_count))
    words_only = first.filter(F.col("phrase").isNotNull())
    out = first.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(1).alias("size"), "f").filter("f > 0")
    held, tables = words_only.count() <= max_words_held, [first]
    if held:
        words = words_only.select("lang", "phrase").toArrow().sort_by([("lang", "ascending"), ("phrase", "ascending")])
        runs, levels = stored(encoded(texts, words)), []
        tables.append(runs)
    for size in range(2, max_words + 1):
        if held:
            level = stored(phrase_counts(runs, levels, min_count))
            tables.append(level)
            found = spelt(level, words, levels)
        else:
            found = windows_by_shuffle(texts, size, min_count)
        out = out.unionByName(found.select("lang", "phrase", F.lit(size).alias("size"), "f"))
        if held and size < max_words:
            held = level.count() <= max_phrases_held
            if held:
                levels = [*levels, np.sort(level.select("key").toArrow().column("key").to_numpy())]
    out = stored(out)
    dropped(*tables)
    return out


def scored(grams: DataFrame, max_words: int = 4) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more of a frequent_phrases() table: the cut of
    lowest score, of equals the first."""
    known = grams.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))
    whole = grams.filter("size > 1").withColumn("w", F.split("phrase", " ", -1))
    cuts = whole.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    left = F.struct(F.lit(0).alias("side"), F.expr("array_join(slice(w, 1, k), ' ')").alias("part"))
    right = F.struct(F.lit(1).alias("side"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("part"))
    parts = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(left, right)))
    counts = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n"))).alias(f"{'lr'[side]}{k}") for k in range(1, max_words) for side in (0, 1)]
    by_phrase = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(*counts)
    # 38 digits hold 2,000,000 times any 64-bit count
    score = lambda k: F.expr(f"CAST((CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(10, 0))) div (CAST(l{k} AS DECIMAL(20, 0)) + r{k}) AS BIGINT)")
    each = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_words)]
    best = F.least(*each) if len(each) > 1 else each[0]
    return by_phrase.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def within_longer(grams: DataFrame) -> DataFrame:
    """(lang, phrase, f): phrases of two words or more that stand within a longer frequent one, and the most occurrences of such."""
    longer = grams.filter("size > 2").withColumn("w", F.split("phrase", " ", -1))
    inner = "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    return longer.select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """With `rank`, the first `top` rows of each language; what is ranked at once is of bounded size."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = found.count()
    while rows > max(RANKED_ROWS, 2 * top):
        salts = -(-rows // max(RANKED_ROWS, 2 * top))
        salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        found = stored(salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt"))
        before, rows = rows, found.count()
        if rows > before // 2:
            break  # many languages of few phrases each
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, lang_col: str = "lang", text_col: str = "text", **held: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first `top` phrases by score, then a, then phrase in byte
    order. a, l and r count the phrase and the two parts of its lowest-scoring cut, n the language's words; the
    score is floor(2000000 a / (l + r)). A phrase is left out where a longer frequent one around it has 80 % of its
    occurrences or more. Without frequent phrases, no rows."""
    grams = frequent_phrases(docs, min_count, max_words, lang_col, text_col, **held)
    around = within_longer(grams).withColumnRenamed("f", "around")
    hidden = F.expr("CAST(100 AS DECIMAL(10, 0)) * CAST(around AS DECIMAL(20, 0)) >= CAST(80 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))")
    best = stored(scored(grams, max_words).join(around, ["lang", "phrase"], "left").filter(~F.coalesce(hidden, F.lit(False))).drop("around"))
    totals = F.broadcast(grams.filter("size = 0").select("lang", F.col("f").alias("n")))  # a row a language
    return first_of_each(best, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i + 1 : i + m], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.f + r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[i + 1 : i + s], ' ') AS phrase, max(a) AS f FROM (SELECT lang, w, a, m, s, unnest(range(0, m - s + 1)) AS i FROM c, (SELECT unnest(range(2, 4)) AS s) WHERE s < m) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR CAST(100 AS HUGEINT) * o.f < CAST(80 AS HUGEINT) * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
"""
