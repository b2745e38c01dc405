import random

import numpy as np

from webloom.llm import near_dedup, queries
from webloom.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def multiset(text, weighting="presence"):
    w = text.lower().split()
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        out[s] = out.get(s, 0) + 1 if weighting == "count" else 1
    return out


def similarity(a, b):
    low = sum(min(n, b.get(s, 0)) for s, n in a.items())
    total = sum(a.values()) + sum(b.values()) - low
    return low / total if total else 0


def brute_classes(rows, weighting="presence"):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    keys, sets = list(texts), [multiset(t, weighting) for t in texts]
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for g in by.values() for i in g for j in g if i < j}
    for i, j in pairs:
        if similarity(sets[i], sets[j]) >= 0.8:
            parent[root(j)] = root(i)
    groups = {}
    for i, t in enumerate(keys):
        groups.setdefault(root(i), []).extend(texts[t])
    return sorted(sorted(g) for g in groups.values())


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(g) for g in out.values())


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    for size in (3, 40, 2000):
        e = rng.integers(0, 2**63, size, dtype=np.uint64)
        x, y = rng.random(size) * 3 + 0.1, rng.random(size) * 3 + 0.1
        with np.errstate(over="ignore"):
            a, b = near_dedup.dart_minhash(e, x, 2048), near_dedup.dart_minhash(e, y, 2048)
        assert abs((a == b).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert grouped(queries.op9_minhash_near_dedup(spark, SF).collect()) == brute_classes(rows)


def test_planted(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 200, 900]))]
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "a b"), (905, "same line\n" * 4000), (906, "same line\n" * 4100)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, sig string, a int, h1 int")
    got = near_dedup.classes(df).collect()
    assert grouped(got) == brute_classes(rows)
    counted = near_dedup.classes(df, weighting="count").collect()
    assert grouped(counted) == brute_classes(rows, "count") and {905, 906} in map(set, grouped(counted))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [g[0] for g in brute_classes(rows)]
    again = df.unionByName(df)
    assert sorted(r.doc_id for r in near_dedup.keep_one(again).collect()) == [g[0] for g in brute_classes(rows)]
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_keep_one_of_any_ids(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))
    a, b, c, d = line(), line(), line(), line()
    near = a.replace(a.split()[-1], "other")
    rows = [(5, a), (3, near), (None, a), (None, b), (None, b), (3, c), (7, c), (7, d), (7, d), (9, None), (None, ""), (8, d)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _label string, _h1 int")
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, near), (None, b), (3, c), (7, d), (9, None)], key=str)
    assert near_dedup.keep_one(df.limit(0)).count() == 0


def template_family(n, unique, seed=4, length=200):
    """(doc_id, text): n texts that share all but `unique` words at their ends, each with a near copy at about 0.81."""
    rng = random.Random(seed)
    noise = lambda k: [f"n{rng.randint(0, 10**9)}" for _ in range(k)]
    template, rows = noise(length - unique), []
    for i in range(n):
        own = noise(unique)
        other = own[: len(own) - (length // 10)] + noise(length // 10)
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + other))]
    return rows


def test_template_family(spark):
    rows = template_family(200, 30)
    sets, links, where = [set(multiset(t)) for _, t in rows], [0] * len(rows), list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                links[i] += 1
                links[j] += 1
                where = [where[i] if x == where[j] else x for x in where]
    want = {}
    for d, x in enumerate(where):
        want.setdefault(x, []).append(d)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(near_dedup.classes(df).collect()) == sorted(want.values()) and len(want) == 200
    assert {r.doc_id: r.n_links for r in near_dedup.classes(df, all_links=True).collect()} == dict(enumerate(links))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102)) and all(got[i] == 200 for i in range(200, 251))
