"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, banded joining, exact check.

Words are what white space separates in the lower-cased text; shingles are runs of five words (a shorter
text is one shingle). A shingle weighs 1 (weighting "presence") or as often as it occurs ("count", under which
texts that mostly repeat the same line are alike whatever else they say). Two texts are linked if their weighted
Jaccard similarity is 0.8 or more; classes are the connected components of links and exact copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import rare_prefixes
from webloom.llm.common import columns_of, dropped, fresh, in_small_batches, quoted, run_once, slices, stored, text_or_empty
from webloom.llm.components import connected_components

#: Rows of a key table up to which it is broadcast; beyond, the same join is made by shuffle.
BROADCAST_KEYS = 400_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """64-bit hashes of the text's word shingles, in order; empty without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = min(n, len(h))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = mix(out + h[j : j + len(out)] + GOLDEN)
    return out


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int = 128) -> np.ndarray:
    """k coordinates (64 bits each) of a weighted set; two sets agree in a coordinate with the probability
    of their weighted Jaccard similarity.

    Every element owns a plane of weight by rank, on which its hash throws darts with density one, the same
    in every set. A dart counts if it falls below the element's weight; of the darts that fall to a
    coordinate, the one of least rank is kept. Only ranks under a limit are thrown, which leaves about
    k ln k + 4k darts whatever the set's size; it is raised in the rare case of an empty coordinate."""
    whole = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), whole)
    slab = np.arange(len(element)) - np.repeat(np.cumsum(whole) - whole, whole)
    seed = mix(elements[element] + GOLDEN * (slab.astype(np.uint64) + np.uint64(1)))
    top = weights[element] - slab  # of a slab [0, 1), the part below the weight
    partial = bool((top < 1).any())
    limit = (k * np.log(k) + 4 * k) / weights.sum()
    while True:
        ranks, ids = [], []
        if limit > 3:  # few slabs with many darts each: throw them as a table
            n = int(limit + 5 * np.sqrt(limit) + 8)
            keys = mix(seed[:, None] + GOLDEN * np.arange(1, n + 1, dtype=np.uint64))
            rank = np.cumsum(-np.log1p(-((keys >> np.uint64(11)) * 2.0**-53)), axis=1)
            late = np.flatnonzero(rank[:, -1] < limit)  # had not enough darts yet: goes on below
            inside = rank < limit
            who = np.repeat(np.arange(len(seed)), inside.sum(axis=1))
            ranks.append(rank[inside])
            ids.append(keys[inside])
            at = rank[late, -1]
        else:
            n, late, at, who = 0, np.arange(len(seed)), np.zeros(len(seed)), np.zeros(0, dtype=np.int64)
        owners = [who]
        while len(late):
            n += 1
            keys = mix(seed[late] + GOLDEN * np.uint64(n))
            at = at - np.log1p(-((keys >> np.uint64(11)) * 2.0**-53))
            inside = at < limit
            late, at = late[inside], at[inside]
            ranks.append(at)
            ids.append(keys[inside])
            owners.append(late)
        rank, dart, owner = np.concatenate(ranks), mix(np.concatenate(ids) ^ GOLDEN), np.concatenate(owners)
        if partial:
            below = (mix(dart) >> np.uint64(11)) * 2.0**-53 < top[owner]
            rank, dart = rank[below], dart[below]
        order = np.argsort(rank)[::-1]
        coordinate = (dart >> np.uint64(40)) % np.uint64(k)
        out, full = np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=bool)
        out[coordinate[order]] = dart[order]  # the least rank is written last
        full[coordinate] = True
        if full.all():
            return out
        limit *= 2


def weighted(text: str, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles in order and their weights."""
    if weighting not in ("presence", "count"):
        raise ValueError(f"weighting {weighting}")
    elements, counts = np.unique(shingles(text), return_counts=True)
    return elements, counts if weighting == "count" else np.ones(len(counts), dtype=np.int64)


def sketch(text: str, k: int, bands: int, weighting: str = "presence") -> tuple[bytes, np.ndarray] | None:
    """8 bits of each coordinate, for estimates, and a 32-bit key for each band."""
    elements, weights = weighted(text, weighting)
    if not len(elements):
        return None
    sig = dart_minhash(elements, weights.astype(float), k)
    keys = sig.reshape(bands, k // bands)
    band = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    for j in range(keys.shape[1]):
        band = mix(band + keys[:, j])
    return (sig & np.uint64(255)).astype(np.uint8).tobytes(), band.astype(np.uint32).view(np.int32)


def _same_text(text_col: str) -> list[Column]:
    """128 bits that stand for a whole text; null is the empty text."""
    text = text_or_empty(F.col(quoted(text_col)))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def texts(docs: DataFrame, k: int = 128, bands: int = 32, text_col: str = "text", weighting: str = "presence") -> DataFrame:
    """One row per distinct text: node, h1, h2, sig, bands (null where it has no words)."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sigs, keys = [], []
                for text in batch.column(2):
                    found = sketch(text.as_py(), k, bands, weighting)
                    sigs.append(found and found[0])
                    keys.append(found and found[1].tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["h1", "h2", "sig", "bands"])

    sketched = docs.select(*_same_text(text_col), text_or_empty(F.col(quoted(text_col))).alias("text")).mapInArrow(run, "h1 long, h2 long, sig binary, bands array<int>")
    distinct = sketched.groupBy("h1", "h2").agg(F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    return stored(distinct.withColumn("node", F.monotonically_increasing_id()))


def shared_groups(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n), stored: the nodes (node, bands) of each group of n nodes, two or more, that share a band's key."""
    keyed = nodes.filter(F.col("bands").isNotNull()).select("node", F.posexplode("bands").alias("band", "key"))
    # stored, so that the join has nothing but exchanges below it and Spark can split a hot key
    sizes = stored(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    found = stored(keyed.join(sizes, ["band", "key"]).select("band", "key", "node", "n"))
    dropped(sizes)
    return found


def bucket_pairs(groups: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) to compare, from shared_groups(): in a key's group every node is paired with two leaders.

    One leader is the node that meets the most others over all its bands: among copies of one original, that
    is the original, which is closer to each of them than they are to each other. The other is the first by hash.
    So pairs grow with the nodes, not with the square of a group; what that leaves open is compared by rest_links, after
    the components of these links are known. Scores and leaders are pre-aggregated sums and maxima, stored before
    they are joined back."""
    scores = stored(groups.groupBy("node").agg(F.sum("n").alias("score")))
    scored = stored(groups.select("band", "key", "node").join(scores, "node"))
    by_hash = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("node"))
    led = stored(scored.groupBy("band", "key").agg(F.max(F.struct("score", by_hash.alias("o"))).alias("x"), F.min(by_hash).alias("y")).select("band", "key", F.array("x.o.node", "y.node").alias("leaders")))
    pairs = scored.join(led, ["band", "key"]).select("node", F.explode("leaders").alias("leader")).filter("node <> leader")
    found = stored(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    dropped(scores, scored, led)
    return found


def candidates(nodes: DataFrame, groups: DataFrame, k: int = 128, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b) of texts that share a band's key (see bucket_pairs) and whose signatures do not rule out the
    threshold: estimates within four standard errors of it stay."""
    pairs = bucket_pairs(groups)
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    least = threshold - 4 * (threshold * (1 - threshold) / k) ** 0.5

    def agree(sa: pd.Series, sb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (sa, sb))
        return pd.Series((x == y).mean(axis=1))

    estimate = run_once(agree, "double")
    return both.select("a", "b", estimate("sa", "sb").alias("estimate")).filter(F.col("estimate") >= least)


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text_col: str = "text", weighting: str = "presence") -> DataFrame:
    """(node, set): the shingles of the wanted nodes, each as often as it weighs."""
    wanted = stored(wanted.select("node").join(nodes.select("node", "h1", "h2"), "node"))

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                found = [np.repeat(*weighted(t.as_py(), weighting)).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "set"])

    texts_of = docs.select(*_same_text(text_col), text_or_empty(F.col(quoted(text_col))).alias("text")).join(_small(wanted), ["h1", "h2"])
    # copies of a text give the same set; one is enough
    return stored(texts_of.select("node", "text").mapInArrow(run, "node long, set binary").groupBy("node").agg(F.any_value("set").alias("set")))


def numbered(elements: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: the n-th copy of an element is an element of its own."""
    _, start, n = np.unique(elements, return_index=True, return_counts=True)
    copy = (np.arange(len(elements)) - np.repeat(start, n)).astype(np.uint64)
    return mix(elements + GOLDEN * copy)


def rest_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, labels: DataFrame | None, threshold: float = 0.8, text_col: str = "text", weighting: str = "presence") -> DataFrame:
    """(a, b, similarity) of the links between different labels that the leaders of bucket_pairs leave, by exact comparison
    (see rare_prefixes): no pair that shares a band's key is passed over. Without labels, of all links in such groups."""
    left = stored(rare_prefixes.open_nodes(groups, labels))
    sets = sets_of(docs, nodes, left, text_col, weighting).join(left, "node")

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                found = [numbered(np.frombuffer(s.as_py(), dtype=np.uint64)).tobytes() for s in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["node", "label", "set"])

    return rare_prefixes.links_between(stored(sets.select("node", "label", "set").mapInArrow(run, "node long, label long, set binary")), threshold)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float = 0.8, text_col: str = "text", weighting: str = "presence") -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard similarity is at least `threshold`, with it."""
    pairs = stored(pairs.select("a", "b"))
    sets = sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text_col, weighting)

    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            ua, ca = np.unique(a, return_counts=True)
            ub, cb = np.unique(b, return_counts=True)
            _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
            common = int(np.minimum(ca[ia], cb[ib]).sum())
            out.append(common / (len(a) + len(b) - common))
        return pd.Series(out, dtype="float64")

    exact = run_once(jaccard, "double")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", exact("x", "y").alias("similarity")).filter(F.col("similarity") >= threshold)


def labelled(docs: DataFrame, threshold: float, k: int, bands: int, id_col: str, text_col: str, weighting: str, all_links: bool) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (id, h1, h2, label, n_links) of each row, and of each label the least id and the number of rows. Both
    are stored, so that a join of them has nothing but exchanges below it and Spark can split a large class."""
    nodes = texts(docs, k, bands, text_col, weighting)
    groups = shared_groups(nodes)
    links = stored(verified(docs, nodes, candidates(nodes, groups, k, threshold), threshold, text_col, weighting))
    labels = connected_components(links)
    rest = stored(rest_links(docs, nodes, groups, None if all_links else labels, threshold, text_col, weighting))
    if rest.limit(1).count():
        links = stored(links.select("a", "b").union(rest.select("a", "b")).distinct())
        labels = connected_components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("node", "h1", "h2").join(labels, "node", "left").join(ends, "node", "left")
    placed = placed.select("h1", "h2", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = stored(docs.select(F.col(quoted(id_col)).alias("id"), *_same_text(text_col)).join(placed, ["h1", "h2"]).select("id", "h1", "h2", "label", "n_links"))
    return rows, stored(rows.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows")))


@in_small_batches
def classes(docs: DataFrame, threshold: float = 0.8, k: int = 128, bands: int = 32, id_col: str = "doc_id", text_col: str = "text", weighting: str = "presence", all_links: bool = False) -> DataFrame:
    """One row per row of `docs`: id_col, class_id (the least id in its class), n_links and class_rows.

    n_links counts the links of its text with other texts. Links inside a class that others already hold together are
    only all compared with `all_links`, which takes the square of a large class; without it n_links counts those found.

    Exact copies are one text; null is the empty text, and texts without words are alike only if
    they are equal. Null ids count as greater than any other. Other columns are not read."""
    rows, least = labelled(docs, threshold, k, bands, id_col, text_col, weighting, all_links)
    return rows.join(least, "label").select(F.col("id").alias(id_col), "class_id", "n_links", "class_rows")


@in_small_batches
def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class: that of the least id, or one of those with it if there are several; a class
    without ids keeps one row too. Rows are told apart by id and text, so that an id may be repeated."""
    rows, least = labelled(docs, threshold, 128, 32, id_col, text_col, "presence", False)
    first = F.col("id").eqNullSafe(F.col("class_id"))
    joined = rows.join(least.select("label", "class_id"), "label")
    gone = stored(joined.filter(~first).select("id", "h1", "h2").distinct())
    several = stored(joined.filter(first).groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label"))
    again = stored(rows.join(several, "label").join(least.select("label", "class_id"), "label").filter(first).select("id", "h1", "h2", "label").distinct())
    h1, h2, label, of, g1, g2 = fresh(docs.columns, "_h1", "_h2", "_label", "_of", "_g1", "_g2")
    names = {"id": of, "h1": g1, "h2": g2, "label": label}
    same = F.col(quoted(id_col)).eqNullSafe(F.col(of)) & (F.col(h1) == F.col(g1)) & (F.col(h2) == F.col(g2))
    text_key = _same_text(text_col)
    kept = docs.withColumns({h1: text_key[0], h2: text_key[1]}).join(_small(gone.withColumnsRenamed(names)), same, "left_anti")
    if again.limit(1).count():
        twice = _small(again.withColumnsRenamed(names))
        one_each = kept.join(twice, same).dropDuplicates([label]).select(*kept.columns)
        kept = kept.join(twice, same, "left_anti").unionByName(one_each)
    return kept.select(*columns_of(docs))
