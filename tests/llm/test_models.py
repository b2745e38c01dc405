import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF
from webloom.llm import language_id, queries, toxicity


def in_fifth(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def counts_of(texts):
    rows = {}
    for lang, t in texts:
        b = language_id.LEAD + t.encode()
        for i in range(len(b) - 3):
            key = lang, int.from_bytes(b[i : i + 4], "big")
            rows[key] = rows.get(key, 0) + 1
    return pd.DataFrame([(k[0], k[1], n) for k, n in rows.items()], columns=["lang", "gram", "n"])


class PlainModel:
    """Prediction by partial matching, byte by byte, over dictionaries of counts."""

    def __init__(self, texts):
        self.seen = [{} for _ in range(4)]  # by order: context -> symbol -> count
        for t in texts:
            b = language_id.LEAD + t.encode()
            for i in range(3, len(b)):
                for order in range(4):
                    symbols = self.seen[order].setdefault(b[i - order : i], {})
                    symbols[b[i]] = symbols.get(b[i], 0) + 1

    def bits(self, text):
        b, total = language_id.LEAD + text.encode(), 0.0
        for i in range(3, len(b)):
            p, excluded = 1.0, set()
            for order in (3, 2, 1, 0):
                seen = {s: n for s, n in self.seen[order].get(b[i - order : i], {}).items() if s not in excluded}
                if not seen:
                    continue
                size = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    p *= seen[b[i]] / size
                    break
                p *= len(seen) / size
                excluded |= set(seen)
            else:
                p /= 256 - len(excluded)
            total -= math.log2(p)
        return total


def test_code_lengths_are_exact():
    texts = [("en", "the cat and the hat sat"), ("en", "that then"), ("fr", "le chat et les rats là"), ("fr", "été")] + [(f"x{i:02}", f"{chr(97 + i)}b{i}") for i in range(12)]
    counts = counts_of(texts)
    model = language_id.build_model(counts)
    plain = [PlainModel([t for la, t in texts if la == lang]) for lang in model.languages]
    assert len(model.languages) == 14 and len(model.tables) == 2
    for text in ("the hat", "les chats là", "zzz été Q", "", "a\nb", "日本"):
        got = model.bits([text.encode(), b"x"])[0]
        assert np.allclose(got, [m.bits(text) for m in plain], rtol=1e-4, atol=1e-3)


def test_language_query_against_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    train = {}
    for r in rows:
        if r.text and r.lang is not None and not in_fifth(r.doc_id):
            train.setdefault(r.lang, set()).add(r.text)
    plain = {lang: PlainModel(texts) for lang, texts in sorted(train.items())}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
        elif len(r.text) < 6000:
            bits = {lang: m.bits(r.text) for lang, m in plain.items()}
            best = min(bits, key=bits.get)
            p = 1 / sum(2.0 ** -min(500, x - bits[best]) for x in bits.values())
            assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - p) < 1e-3


def test_sample_is_bounded_and_even(spark):
    rows = [(f"l{i % 3}" if i % 4 else "l0", f"text {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = language_id.bounded_sample(df, 20, 1000).collect()
    by = {}
    for r in got:
        by.setdefault(r.lang, set()).add(r.text)
    assert sorted(map(len, by.values())) == [20, 20, 20] and len(got) == 60
    assert sorted((r.lang, r.text) for r in got) == sorted((r.lang, r.text) for r in language_id.bounded_sample(df.union(df), 20, 1000).collect())
    assert language_id.bounded_sample(df, 20, 15).count() == 15


def test_language_query(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == in_fifth(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark):
    rows = [(1, "the cat sat on the mat " * 20, "en", 1.0), (2, "le chat est sur la table " * 20, "fr", 1.0), (3, None, "en", 1.0), (4, "", None, 0.0), (5, "123 !?", "fr", 0.0), (6, "the " * 200_000, None, 0.0), (7, "x", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _BITS double")
    model = language_id.fit(df)
    found = language_id.predict(df, model)
    assert found.columns == [*df.columns, "_lang", "_score", "_bits_"]
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i]._lang for i in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[7]._lang in ("en", "fr") and got[3]._score == 0
    assert language_id.fit(df.limit(0)) is None
    assert [r._lang for r in language_id.predict(df.limit(1), None).collect()] == ["und"]
    assert language_id.predict(df.limit(0), model).count() == 0


def letters(i):
    return "".join(chr(97 + int(x)) for x in f"{i:04}")


def test_interactions_are_learned(spark):
    """Neither word says anything by itself; noise words are as many as a small corpus has."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(8000):
        insult, group = i % 2, (i // 2) % 2
        words = [letters(x) for x in rng.integers(0, 1000, 25)] + ["rude"] * insult + ["people"] * group
        rows.append((i, " ".join(words), int(insult != group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df)
    noise = " ".join(letters(x) for x in range(0, 1000, 50))
    rude, people, both, neither = model.margins([f"rude {noise}", f"people {noise}", f"rude people {noise}", noise])
    assert min(rude, people) > 0.5 and max(both, neither) < -0.1
    # the margin is the plain double sum
    f = toxicity.buckets_of(["rude people " + noise], model.buckets)[0]
    f = model.place[f]
    plain = model.bias + sum(float(model.weight[a]) for a in f) + sum(float(model.factors[a].astype(float) @ model.factors[b]) for x, a in enumerate(f) for b in f[x + 1 :])
    assert abs(plain - both) < 1e-6
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "RUDE, rude! " * 50_000, 9)], "doc_id long, text string, _Score int")
    found = toxicity.score(odd, model)
    assert found.columns == [*odd.columns, "_score_"]
    got = {r.doc_id: r._score_ for r in found.collect()}
    assert got[1] == got[2] < 0.6 < got[3]
    assert toxicity.fit(df, df.filter("label = 0")) is None and toxicity.fit(df.limit(0), df) is None and toxicity.fit(df, df.limit(0)) is None
    assert [r._score_ for r in toxicity.score(odd, None).collect()] == [0.0] * 3
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_query_against_plain_version(spark):
    """Features, sample, order of training and scores in plain Python; only the descent itself is shared."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic in (0, 1) and not in_fifth(r.doc_id)}
    word = re.compile(r"[^\W\d_]+")
    features = lambda t: sorted({zlib.crc32(w.encode()) % 2**20 for w in word.findall((t or "").lower())})
    ids = sorted(d for d in labels if d in docs)
    model = toxicity.train([np.array(features(docs[d]), dtype=np.int32) for d in ids], np.array([labels[d] for d in ids], dtype=float), 2**20)
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        f = features(text)
        if len(f) < 400:
            w, v = model.weight.astype(float), model.factors.astype(float)
            f = model.place[f]
            z = model.bias + sum(w[a] for a in f) + sum(v[a] @ v[b] for x, a in enumerate(f) for b in f[x + 1 :])
            want = 1 / (1 + math.exp(-max(-30, min(30, z))))
            assert abs(got[d].score - want) < 1e-6 and got[d].predicted == int(want >= 0.5)


def test_toxicity_query(spark):
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[r.doc_id].score, r.toxic) for r in labels if in_fifth(r.doc_id)]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == in_fifth(i) for i, r in got.items())


def test_descent_against_plain_loops():
    """Two epochs of one batch, term by term and pair by pair."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, rng.integers(0, 6))).astype(np.int32) for _ in range(40)]
    labels = np.array([float(4 in r or rng.random() < 0.2) for r in rows])
    rate, factor_rate, weak, strong, k = 0.3, 0.05, 0.2, 100.0, 2
    model = toxicity.train(rows, labels, 16, factors=k, epochs=2, rate=rate, factor_rate=factor_rate, weak=weak, strong=strong, seed=7)
    seen = sorted({int(t) for r in rows for t in r})
    share = labels.mean()

    def evidence(t):
        inside = [y for r, y in zip(rows, labels, strict=True) if t in r]
        n, p = len(inside), sum(inside)
        part = lambda x, expected: x * math.log(x / expected) if x else 0.0
        return 2 * (part(p, n * share) + part(n - p, n * (1 - share)))

    prior = {t: weak if evidence(t) > 2 * math.log(len(seen)) else strong for t in seen}
    assert set(prior.values()) == {weak, strong}
    start = np.random.default_rng(7).normal(0, 0.02, (len(seen), k)).astype(np.float32)
    v = {t: [float(x) for x in start[i]] for i, t in enumerate(seen)}
    w, bias, gb = dict.fromkeys(seen, 0.0), math.log(share / (1 - share)), 1.0
    gw, gv = dict.fromkeys(seen, 1.0), {t: [1.0] * k for t in seen}
    for _ in range(2):
        errors = []
        for r, y in zip(rows, labels, strict=True):
            z = bias + sum(w[int(t)] for t in r) + sum(sum(a * b for a, b in zip(v[int(s)], v[int(t)], strict=True)) for i, s in enumerate(r) for t in r[i + 1 :])
            errors.append(1 / (1 + math.exp(-z)) - y)
        gb += sum(errors) ** 2
        bias -= rate * sum(errors) / math.sqrt(gb)
        dw = {t: sum(e for r, e in zip(rows, errors, strict=True) if t in r) + prior[t] * w[t] for t in seen}
        dv = {t: [sum(e * sum(v[int(s)][f] for s in r if s != t) for r, e in zip(rows, errors, strict=True) if t in r) + strong * v[t][f] for f in range(k)] for t in seen}
        for t in seen:
            gw[t] += dw[t] ** 2
            w[t] -= rate * dw[t] / math.sqrt(gw[t])
            for f in range(k):
                gv[t][f] += dv[t][f] ** 2
                v[t][f] -= factor_rate * dv[t][f] / math.sqrt(gv[t][f])
    assert model.bias == pytest.approx(bias, abs=1e-5)
    for t in seen:
        assert float(model.weight[model.place[t]]) == pytest.approx(w[t], abs=1e-4)
        assert [float(x) for x in model.factors[model.place[t]]] == pytest.approx(v[t], abs=1e-4)
