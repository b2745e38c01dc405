"""Benchmark decontamination with DataFrame operations only: every window of every document meets a broadcast hash set
of normalised benchmark n-grams, and what it hits is compared word by word.

Results depend on a text alone, so a text is known by 128 bits of it, whatever rows hold it."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import columns_of, dropped, fresh, quoted, stored

#: A word, after A-Z is lower-cased: a run of digits, a-z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hashes in one broadcast set, about 64 MB; a larger benchmark is met in several passes of the same plan.
SET_SIZE = 1_000_000
#: Rows (or list entries) of a table of hits up to which it is broadcast; beyond, the same join is made by shuffle.
BROADCAST_HITS = 200_000


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, window, h, items): each distinct window of `n` words, or whole shorter item, with the ids of
    the items that hold it. Items without words (null or empty texts too) have none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    spans = items.withColumn("size", F.least(F.size("w"), F.lit(n))).withColumn("at", F.explode(F.expr("sequence(0, size(w) - size)")))
    windows = spans.select("item", "size", F.expr("slice(w, at + 1, size)").alias("ws"))
    windows = windows.select("item", "size", F.array_join("ws", " ").alias("window"), F.expr("xxhash64(transform(ws, x -> xxhash64(x)))").alias("h"))
    return windows.groupBy("size", "window", "h").agg(F.collect_set("item").alias("items"))


def _key(text: Column) -> Column:
    """128 bits of a text; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def probed(docs: DataFrame, windows: DataFrame, text_col: str, set_size: int, heads: bool) -> DataFrame:
    """(kept, key, n_words, pos, at, size, window): the windows of texts whose hash is in the set of `windows` (a stored
    table), numbered by pos from 1. With `heads` every row of `docs` has a row of pos 0 besides, with its columns but
    the text as `kept`.

    Windows are long numbers when they meet the set; only what is met takes its words along."""
    n, sizes = windows.count(), sorted(r[0] for r in windows.select("size").distinct().collect())  # sizes are n at most
    passes = max(1, -(-n // set_size))
    text = F.col(quoted(text_col))
    kept = columns_of(docs, text_col) if heads else []
    split = docs.select(F.struct(*(kept or [F.lit(0).alias("none")])).alias("kept"), _key(text).alias("key"), words(text).alias("w"))
    # hs is bound once for all windows of a text; the first number, 0, stands for the row itself
    hashes = ["array(0L)"] + [f"if(size(hs) >= {s}, transform(sequence(0, size(hs) - {s}), i -> xxhash64(slice(hs, i + 1, {s}))), array())" for s in sizes]
    spans = F.expr(f"flatten(transform(array(transform(w, x -> xxhash64(x))), hs -> concat({', '.join(hashes)})))")
    every = split.select("kept", "key", "w", F.posexplode(spans).alias("pos", "h"))
    found = None
    for k in range(passes):
        own = windows.filter(F.pmod("h", F.lit(passes)) == k).select(F.col("h").alias("in_set"), "size").distinct()
        if heads and k == 0:
            own = own.unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("in_set"), F.lit(0).alias("size")))
        met = every.join(F.broadcast(own), (F.col("h") == F.col("in_set")) & ((F.col("pos") == 0) == (F.col("size") == 0)))
        found = met if found is None else found.unionByName(met)
    at, before = F.lit(None).cast("int"), F.lit(1)
    for s in sizes:  # windows are numbered size by size
        at = F.when(F.col("size") == s, F.col("pos") - before).otherwise(at)
        before = before + F.greatest(F.size("w") - s + 1, F.lit(0))
    placed = found.select("kept", "key", "w", F.size("w").cast("long").alias("n_words"), "pos", at.alias("at"), "size")
    return placed.select("kept", "key", "n_words", "pos", "at", "size", F.when(F.col("size") > 0, F.expr("array_join(slice(w, at + 1, size), ' ')")).alias("window"))


def hits(met: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, at, size, items): every occurrence of a benchmark window among probed() ones, once for equal texts. The words
    themselves are compared; a hash that only looked alike finds no partner."""
    exact = windows.select("window", "size", "items")
    exact = F.broadcast(exact) if exact.count() <= BROADCAST_HITS else exact
    return met.filter("pos > 0").select("key", "at", "size", "window").join(exact, ["window", "size"]).select("key", "at", "size", "items").distinct()


def merged(found: DataFrame) -> DataFrame:
    """(key, spans, items) of each text of hits(): the hit runs of words as [a, b), and the sorted item ids."""
    before = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    opens = found.withColumn("until", F.max(F.col("at") + F.col("size")).over(before)).withColumn("new", F.when(F.col("until").isNull() | (F.col("at") > F.col("until")), 1).otherwise(0))
    runs = opens.withColumn("run", F.sum("new").over(Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("size")).alias("b"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", set_size: int = SET_SIZE) -> DataFrame:
    """`docs` without its text and with, last, _n_words, _n_hit, _items (sorted strings) and _spans (the hit runs of
    words, as start and end); where `docs` has a column of that name, ours has more underscores behind.

    One row per row of `docs`, whatever its ids; null and empty texts have no words."""
    n_words, n_hit, items, spans = fresh(docs.columns, "_n_words", "_n_hit", "_items", "_spans")
    windows = stored(benchmark_windows(benchmark, n))
    met = stored(probed(docs, windows, text_col, set_size, True))
    by_text = stored(merged(hits(met, windows)))
    size = by_text.agg(F.coalesce(F.sum(F.size("spans") + F.size("items")), F.lit(0))).first()[0]
    rows = met.filter("pos = 0").select("kept", "key", "n_words")
    both = rows.join(F.broadcast(by_text) if size <= BROADCAST_HITS else by_text, "key", "left")
    keep = [F.col("kept").getField(c).alias(c) for c in docs.columns if c != text_col]
    found = F.coalesce("spans", F.expr("CAST(array() AS array<struct<a:int,b:int>>)"))
    return both.select(*keep, F.col("n_words").alias(n_words), F.expr("aggregate(coalesce(spans, array()), 0L, (n, x) -> n + x.b - x.a)").alias(n_hit), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias(items), found.alias(spans))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", set_size: int = SET_SIZE) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark window; every other row stays as it is."""
    (key,) = fresh(docs.columns, "_key")
    windows = stored(benchmark_windows(benchmark, n))
    bad = stored(hits(probed(docs, windows, text_col, set_size, False), windows).select(F.col("key").alias(key)).distinct())
    dropped(windows)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_HITS else bad
    return docs.withColumn(key, _key(F.col(quoted(text_col)))).join(bad, key, "left_anti").select(*columns_of(docs))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
       FROM (SELECT item, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM w, sizes WHERE len(w) >= size)),
h AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
