import random
import re
from collections import Counter

import pytest

from tests.conftest import SF
from tests.llm.oracle import same
from webloom.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_count, top, max_words=4):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    words = ["New", "york", "the", "a", "Über", "x\x1cy", " ", "city"] + [f"w{i}" for i in range(8)]
    docs = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t ", ". ", "\x0b", "\n"]) for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    docs += [("en", "a very good day, a very good day!")] * 30 + [("en", None), (None, ""), ("fr", " .,;"), ("es", "x" * 5000), ("en", "a a a a a a a a " * 50)]
    return docs


def test_query(spark):
    assert same(spark, queries.op13_phrase_mining, queries.oracle_sql()["op13_phrase_mining"], SF) > 10


@pytest.mark.parametrize("held", [{}, {"max_words_held": 0}, {"max_phrases_held": 0}, {"max_phrases_held": 60}])
def test_as_by_brute_force(spark, held):
    docs = made(4)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = phrases.collocations(frame, min_count=6, top=40, **held)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 6, 40)


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Tasks that hand on early, groups that are ranked in several rounds."""
    docs = made(8)
    frame = spark.createDataFrame(docs, "lang string, text string")
    want = plain(docs, 4, 10)
    monkeypatch.setattr(phrases, "RANKED_ROWS", 5)
    assert sorted(tuple(r) for r in phrases.collocations(frame, min_count=4, top=10).collect()) == want


def test_counts_past_32_bits(spark):
    grams = [("en", None, 0, 2**62), ("en", "a", 1, 2**61), ("en", "b", 1, 2**61 + 1), ("en", "a b", 2, 2**61 - 5)]
    (row,) = phrases.scored(spark.createDataFrame(grams, "lang string, phrase string, size int, f long")).collect()
    assert tuple(row) == ("en", "a b", 2**61 - 5, 2**61, 2**61 + 1, 2000000 * (2**61 - 5) // (2**62 + 1))


def test_odd_tables(spark):
    schema = "text string, phrase int, f int, lang string, size string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, 1, None, None), ("", 1, 1, "en", "x"), ("new york " * 3, 1, 1, "en", "x")]
    got = phrases.collocations(spark.createDataFrame(rows, schema), min_count=2, max_words=2).collect()
    assert [tuple(r) for r in got] == [("en", 1, "new york", 3, 3, 3, 6, 1000000), ("en", 2, "york new", 2, 3, 3, 6, 666666)]
