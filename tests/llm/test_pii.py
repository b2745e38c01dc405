import hashlib
import itertools
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from webloom.llm import pii, queries
from webloom.llm.pii import KINDS, Segment, SemiMarkovField

sys.set_int_max_str_digits(0)
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_base(text):
    """The patterns as they are told, by the plain regular expressions."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append((k, *m.span()))
    return out


ODD = [
    "", "@", "a@b@c.de f@@g.h", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1.1 0001.2.3.00255", "1.2.3", "+1 ( ) -", "+1+2345678901", "+12 345 678 90 +", "4111 1111 1111 1111 +1 (407) 555-7710 4111111111111111",
    "4111111111111111-4111111111111111", "mail me+x%y@mail-7.example.com.", "a" * 3000 + "@" + "b" * 3000, "1" * 5000, "9." * 3000, "é４@ü.de ٤٤٤٤", "12345678901234567890", "tel\n+49 30 1234567\n1.2.3.4",
]


def test_base_spans_as_by_plain_patterns():
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("0123456789..--  ()+@ab") for _ in range(rnd.randint(1, 120))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text)[0] == plain_base(text), text


def valued(model, segments):
    total, last = 0.0, len(KINDS)
    for s in segments:
        total += model.score(s) + model.follows[last, s.kind]
        last = s.kind
    return total


def all_segmentations(segments):
    for n in range(len(segments) + 1):
        for some in itertools.combinations(sorted(segments, key=lambda s: (s.start, s.end)), n):
            if all(a.end <= b.start for a, b in zip(some, some[1:], strict=False)):
                yield some


def test_best_and_likelihood_as_by_all_segmentations():
    rnd, rng = random.Random(5), np.random.default_rng(5)
    for _ in range(60):
        model = SemiMarkovField(rng.normal(0, 1, 64), rng.normal(0, 1, (5, 4)))
        segments = []
        for i in range(rnd.randint(1, 7)):
            start = rnd.randint(0, 8)
            segments.append(Segment(start, start + rnd.randint(1, 4), rnd.randint(0, 3), [f"f{i}", "bias"]))
        every = list(all_segmentations(segments))
        assert valued(model, model.best(segments)) == pytest.approx(max(valued(model, x) for x in every))
        free = [x for x in every if all(s.end <= 3 or s.start >= 5 for s in x)]
        assert valued(model, model.best(segments, [(3, 5)])) == pytest.approx(max(valued(model, x) for x in free))


def test_training_follows_the_gradient_of_the_likelihood():
    """One step of training raises the weights that a numeric derivative of the log-likelihood says should rise."""
    segments = [Segment(0, 2, 0, ["a"]), Segment(1, 3, 2, ["b"]), Segment(3, 5, 2, ["b", "c"]), Segment(2, 4, 3, ["d"])]
    truth = {(0, 2, 0), (3, 5, 2)}

    def likelihood(model):
        values = [valued(model, x) for x in all_segmentations(segments)]
        own = next(valued(model, x) for x in all_segmentations(segments) if {(s.start, s.end, s.kind) for s in x} == truth)
        return own - np.log(np.exp(values).sum())

    model = pii.train([(segments, truth)], buckets=32, rounds=1, prior=0.0)
    for i in range(32):
        up, down = SemiMarkovField(np.zeros(32), np.zeros((5, 4))), SemiMarkovField(np.zeros(32), np.zeros((5, 4)))
        up.weight[i], down.weight[i] = 1e-5, -1e-5
        slope = (likelihood(up) - likelihood(down)) / 2e-5
        assert model.weight[i] == pytest.approx(0.5 * slope / np.sqrt(1 + slope**2), abs=1e-6)
    for k in np.ndindex(5, 4):
        up, down = SemiMarkovField(np.zeros(32), np.zeros((5, 4))), SemiMarkovField(np.zeros(32), np.zeros((5, 4)))
        up.follows[k], down.follows[k] = 1e-5, -1e-5
        slope = (likelihood(up) - likelihood(down)) / 2e-5
        assert model.follows[k] == pytest.approx(0.5 * slope / np.sqrt(1 + slope**2), abs=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def added(text, model):
    return [(KINDS[k], text[s:e]) for k, s, e in pii.spans_of(text, model)[1]]


def test_what_patterns_miss(model):
    assert added("call +1 (407) 555-7710 4929348385146306 now", model) == [("card", "4929348385146306"), ("phone", "+1 (407) 555-7710")]
    assert added("7536784127813050 4845168114407329", model) == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert added("mail john.doe at example dot com or jane [at] mail [dot] example [dot] org", model) == [("email", "john.doe at example dot com"), ("email", "jane [at] mail [dot] example [dot] org")]
    assert added("tel (407) 555-7710.", model) == [("phone", "(407) 555-7710")]
    assert added("card 4929.3483.8514.6306", model) == [("card", "4929.3483.8514.6306")]


@pytest.mark.parametrize("text", ["order 4929348385146307", "version 1.2.3.4.5", "2024-01-02 10:11:12 2024-01-03", "isbn 978-3-16-148410-0", "look at home.Then we meet at noon.", "12 34 56 78 90 12 34", "555-7710", "a 1,234,567.89 b"])
def test_what_is_none(model, text):
    assert added(text, model) == []


def test_base_spans_stay_and_nothing_overlaps(model):
    rnd = random.Random(9)
    parts = ["4929348385146306", "+1 (407) 555-7710", "190.137.223.204", "a.b@mail.example.com", "7536784127813050", "x at y dot org", "12-34", "(", " ", " ", "word", "."]
    for _ in range(400):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", "-"]) for _ in range(rnd.randint(1, 8)))
        base, more = pii.spans_of(text, model)
        assert base == plain_base(text)
        for i, (_, s, e) in enumerate(sorted(more, key=lambda x: x[1])):
            assert all(e <= a or b <= s for _, a, b in base), text
            assert all(e <= a or b <= s for _, a, b in sorted(more, key=lambda x: x[1])[:i]), text


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base = plain_base(text or "")
        row = got[doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        spelt = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(spelt).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert set(spelt) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (KINDS.index(x.split(":")[0]), int(x.split(":")[1]), int(x.split(":")[2])))


def test_odd_tables(spark, model):
    schema = "doc_id long, text string, _base string, _SPANS int"
    rows = [(None, None, "x", 1), (1, "", None, None), (1, "", None, None), (2, "é a.b@c.de " + "7 " * 30000, "y", 2)]
    found = pii.find(spark.createDataFrame(rows, schema), model)
    assert found.columns == ["doc_id", "text", "_base", "_SPANS", "_base_", "_spans_"]
    got = sorted(found.select("doc_id", "_base", "_SPANS", F.size("_base_").alias("n"), F.size("_spans_").alias("m")).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, None, None, 0, 0), (1, None, None, 0, 0), (2, "y", 2, 1, 1), (None, "x", 1, 0, 0)]
    empty = spark.createDataFrame([], schema)
    assert pii.fit(empty) is None
    assert pii.find(empty, None).count() == 0
    assert [r[0] for r in pii.find(spark.createDataFrame(rows, schema), None).select(F.size("_spans_")).collect()].count(1) == 1


def test_redacted(spark, model):
    rows = [(1, "write a.b@c.de, x at y dot org or +1 (407) 555-7710 4929348385146306."), (2, None), (3, "clean")]
    got = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "write [email], [email] or [phone] [card].", 2: None, 3: "clean"}
