import random
import re

import pytest

from tests.llm.oracle import same
from webloom.llm import decontaminate, lines, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_line_dedup", "op8_decontamination", "op9_minhash_near_dedup"])
def test_oracle(spark, name):
    assert same(spark, queries.queries()[name], queries.oracle_sql()[name], SF) == 1000


def test_lines(spark):
    rows = [(i, f"all\nonly {i}\n\nall\nsome" if i % 2 else f"all\nonly {i}", "h", 1, 2) for i in range(20)]
    rows += [(50, None, "h", 1, 2), (51, "", None, 1, 2), (52, "all\nall", "other", 1, 2), (52, "all\nall", "other", 1, 2), (None, "all", "h", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _host int, _N_lines int")
    got = lines.drop_boilerplate(df, ratio=0.6, min_pages=3)
    assert got.columns == [*df.columns, "_n_lines_", "_n_dropped"] and {(r._host, r._N_lines) for r in got.collect()} == {(1, 2)}
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, r._n_lines_, r._n_dropped))
    assert by[1] == [("only 1\n\nsome", 5, 2)] and by[2] == [("only 2", 2, 1)]
    assert by[50] == [(None, 0, 0)] and by[51] == [("", 1, 0)] and by[None] == [("", 1, 1)]
    assert by[52] == [("all\nall", 2, 0)] * 2
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def brute(docs, bench, n=10):
    split = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in bench:
        w = split(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    items |= wins[x]
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


@pytest.mark.parametrize("set_size", [1_000_000, 7])
def test_decontaminate(spark, set_size):
    rng = random.Random(7)
    word = lambda: rng.choice(["Aa", "b", "ccc", "É", "9", "x-y"])
    bench = [(i, " ".join(word() for _ in range(rng.randint(3, 9)))) for i in range(4)] + [(7, None), (8, ""), (9, "only"), (10, " - ")]
    docs = [(i, ", ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "A  ONLY\nb"), (103, " ".join([bench[0][1]] * 300)), (104, "x"), (104, "x"), (None, bench[1][1])]
    df = spark.createDataFrame([(*d, "a", "b") for d in docs], "doc_id long, text string, _row string, _n_Hit string")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.report(df, bf, n=4, set_size=set_size)
    assert got.columns == ["doc_id", "_row", "_n_Hit", "_n_words", "_n_hit_", "_items", "_spans"]
    assert sorted(((r.doc_id, r._n_words, r._n_hit_, r._items) for r in got.collect()), key=str) == brute(docs, bench, 4)
    clean = decontaminate.drop_contaminated(df, bf, 4, set_size=set_size)
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((x[0] for x in brute(docs, bench, 4) if not x[2]), key=str)
    for r in got.collect():  # runs do not touch
        assert all(x.b < y.a for x, y in zip(r._spans, r._spans[1:])) and sum(x.b - x.a for x in r._spans) == r._n_hit_
    assert decontaminate.report(df.limit(0), bf).count() == 0
    assert all(r._n_hit_ == 0 for r in decontaminate.report(df, bf.limit(0)).collect())
