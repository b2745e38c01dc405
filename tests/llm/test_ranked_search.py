import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.oracle import same
from webloom.llm import queries, ranked_search
from webloom.llm.ranked_search import RankedIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, asked in wanted.items():
        found = []
        for doc_id, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, doc_id is not None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query(spark):
    assert same(spark, queries.op12_ranked_search, queries.oracle_sql()["op12_ranked_search"], SF) > 1000


@pytest.mark.parametrize("segment_docs", [7, 50_000])
def test_as_by_brute_force(spark, segment_docs):
    rnd = random.Random(segment_docs)
    words = ["the"] * 30 + ["of", "A", "Über", "x1"] * 6 + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # more copies than are asked for
    docs += [(7, docs[7][1]), (None, "the w1 w2"), (2000, None), (2001, ""), (2002, " ,. "), (2003, "w5 " * 20000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for i in range(12)] + [(12, None), (13, ""), (14, "none such"), (15, docs[3][1]), (15, "w9 W9"), (None, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = RankedIndex.build(frame, segment_docs=segment_docs)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for max_pairs in (500_000, 20):
        got = [tuple(r) for r in index.search(asked, k=20, max_pairs=max_pairs).collect()]
        assert sorted(got, key=key) == sorted(plain_search(docs, items, 20), key=key)


def test_every_row_is_indexed_and_bytes_bound_the_impacts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = RankedIndex.build(docs, segment_docs=64)
    rows = index.lists.collect()
    ids = sorted(i for r in rows if r.term is None for i in r.ids)
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes = {r.segment: np.array(r.sizes) for r in rows if r.term is None}
    postings = 0
    for r in rows:
        if r.term is not None:
            at, q, tf = np.frombuffer(r.at, np.int32), np.frombuffer(r.impacts, np.uint8).astype(int), np.frombuffer(r.tf, np.int32).astype(int)
            exact = ranked_search.impacts(tf, ranked_search.length_norms(sizes[r.segment], index.n_docs, index.n_terms)[at])
            assert r.df == len(at) and ((q - 1) * r.step < exact).all() and (exact <= q * r.step).all()
            postings += len(at)
    assert postings == sum(len(set(plain_terms(r.text))) for r in docs.select("text").collect())


def test_bounds_leave_little_to_rescore(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = RankedIndex.build(docs)
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    seen = []
    rescored = ranked_search._rescored

    def watched(known, *rest):
        seen.append(known.count())
        return rescored(known, *rest)

    ranked_search._rescored = watched
    try:
        n = index.search(asked).count()
    finally:
        ranked_search._rescored = rescored
    assert n <= sum(seen) < 2 * n


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, score int")
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert RankedIndex.build(none).search(items).count() == 0
    nulls = spark.createDataFrame([(None, None, 1), (1, None, 2)], none.schema)
    assert RankedIndex.build(nulls).search(items).count() == 0
    some = RankedIndex.build(spark.createDataFrame([(1, "the cat", 3), (2, "dog", 4)], none.schema))
    assert [r.doc_id for r in some.search(items).collect()] == [1]
    assert some.search(items.limit(0)).columns == ["item", "rank", "doc_id", "score"]
    assert some.search(items.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "cat"), ("b", "dog")], "term string, upper string")
    assert sorted(tuple(r)[:3] for r in some.search(named, id_col="term", text_col="upper").collect()) == [("a", 1, 1), ("b", 1, 2)]
