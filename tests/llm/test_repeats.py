import hashlib
import random
from collections import Counter

import pytest

from webloom.llm import queries, repeats

SF = "/root/testdata/sf0.01"


def brute(texts, length=200):
    """For each text its removed runs and what is left."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(x for s in spans for x in s), len(b)]
        out.append((len(b), spans, b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
    return out


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for r, (n, spans, kept) in zip(rows, brute([r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [20_000, 3])
def test_planted(spark, hot):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage = noise(260)
    exact, short = noise(200), noise(180)
    texts = [noise(rng.randint(0, 900)) for _ in range(10)]
    texts += [noise(rng.randint(0, 60)) + passage[rng.randint(0, 40) :] + noise(rng.randint(0, 60)) for _ in range(30)]
    texts += [noise(30) + exact + noise(9), exact, noise(1) + exact, noise(50) + short, short + noise(50)]
    texts += [None, "", "a" * 199, "b" * 200, "c" * 201, "ab" * 700, passage + passage, "x" * 5000, noise(700) * 3]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, doc int, z string"
    for these in (rows, [*rows, rows[0], (None, texts[1], 1, "z")]):
        want = sorted(((r[0], *x) for r, x in zip(these, brute([r[1] for r in these]), strict=True)), key=str)
        got = repeats.removed_spans(spark.createDataFrame(these, schema), hot=hot).collect()
        assert sorted(((r.doc_id, r._n_bytes, [list(s) for s in r._spans], bytes(r._kept)) for r in got), key=str) == want
    assert repeats.removed_spans(spark.createDataFrame([], schema)).count() == 0


def test_long_text_in_chunks(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000)) + base + "".join(rng.choice("abcdefgh ") for _ in range(3000))
    monkeypatch.setattr(repeats, "CHUNK", 700)
    import numpy as np

    with np.errstate(over="ignore"):
        gram, _, at, lo, hi = repeats.nodes_of(np.frombuffer(text.encode(), dtype=np.uint8))
    assert lo[0] == 0 and hi[-1] == len(text) - 200 and (lo[1:] == hi[:-1] + 1).all()
    assert ((at >= hi) & (at - lo <= 150)).all()


def test_no_runs():
    import numpy as np

    assert [len(x) for x in repeats.runs(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] == [0, 0, 0]
    doc, lo, hi = repeats.runs(np.array([1, 0, 0, 0]), np.array([5, 4, 3, 9]))
    assert list(zip(doc, lo, hi, strict=True)) == [(0, 3, 4), (0, 9, 9), (1, 5, 5)]
