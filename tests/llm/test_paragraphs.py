import random
import re

import numpy as np

from webloom.llm import paragraphs, queries

SF = "/root/testdata/sf0.01"


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def spaced(b):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", b)]


def units_of(text, min_words):
    """(first byte, end byte, words, whether it is a block) of lines, and of blocks of several lines between blank lines."""
    data, out, at, block = (text or "").encode(), [], 0, []
    blocks, has_blank = [], False
    for line in data.split(b"\n"):
        w = [(at + a, at + b, x) for a, b, x in spaced(lower(line))]
        at += len(line) + 1
        if w:
            block.append(w)
        elif block:
            blocks.append(block)
            block = []
    if block:
        blocks.append(block)
    has_blank = len(blocks) > 1
    for block in blocks:
        kinds = [(w, False) for w in block] + ([([x for w in block for x in w], True)] if has_blank and len(block) > 1 else [])
        out += [(w[0][0], w[-1][1], tuple(x[2] for x in w), is_block) for w, is_block in kinds if len(w) >= min_words]
    return out


def brute_paragraphs(docs, threshold=0.8, min_words=16):
    """Classes of the paragraphs with two places or more: sorted lists of (doc, first byte, end byte)."""
    units, blocks = {}, set()
    for d, t in docs:
        for first, end, words, is_block in units_of(t, min_words):
            units.setdefault(words, []).append((d, first, end))
            if is_block:
                blocks.add((d, first, end))
    keys = list(units)
    sets = [{k[i : i + 5] for i in range(len(k) - 4)} for k in keys]
    by, parent = {}, list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {(i, j) for g in by.values() for i in g for j in g if i < j}:
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
            parent[root(j)] = root(i)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).extend(units[k])
    found = [g for g in groups.values() if len(g) > 1]
    gone = [x for g in found for x in g if x in blocks and x[:2] != min(g)[:2]]
    inside = lambda x: any(x[0] == b[0] and b[1] <= x[1] and x[2] <= b[2] for b in gone)
    found = [[x for x in g if x in blocks or not inside(x)] for g in found]
    return sorted(sorted(g) for g in found if len(g) > 1)


def classes(rows, kind):
    out = {}
    for r in rows:
        if r._kind == kind:
            out.setdefault((r._class_id, r._class_first), []).append((r.doc_id, r._first, r._end))
    for key, members in out.items():
        # a segment's first place may itself stand in too short a run to be a passage; what goes on alike beside a run
        # has its first place beside another one
        assert min(members)[:2] == key if kind == "paragraph" else min(members)[:2] >= key
    return sorted(sorted(g) for g in out.values())


def passages(docs, words=50):
    """(doc, first byte, end byte) of the runs of 50 words or more that stand in two places."""
    seen, split = {}, {d: spaced(lower((t or "").encode())) for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - words + 1):
            seen.setdefault(tuple(x[2] for x in w[i : i + words]), []).append((d, i))
    out = []
    for d, w in split.items():
        hit = [i for i in range(len(w) - words + 1) if len(seen[tuple(x[2] for x in w[i : i + words])]) > 1]
        if hit:
            out.append((d, [(w[i][0], w[i + words - 1][1]) for i in hit]))
    return out


def check(docs, rows):
    assert classes(rows, "paragraph") == brute_paragraphs(docs)
    spans = {}
    for r in rows:
        if r._kind == "passage":
            spans.setdefault(r.doc_id, []).append((r._first, r._end))
    for d, windows in passages(docs):
        for a, b in windows:  # every window of 50 common words holds a segment that was found
            assert any(a <= x and y <= b for x, y in spans.get(d, [])), (d, a, b)
    data = {d: (t or "").encode() for d, t in docs}
    for group in classes(rows, "passage"):
        assert len({tuple(x[2] for x in spaced(lower(data[d][a:b]))) for d, a, b in group}) == 1


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.paragraphs.duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check(docs, found)
    got = queries.op6_paragraph_dedup(spark, SF)
    assert got.columns == ["doc_id", "kind", "first_byte", "end_byte", "n_words", "class_id", "class_first_byte", "removed"] and got.count() == len(found)


def test_planted(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n))
    passage, line = noise(60), noise(120).split()
    docs = [(i, noise(30) + "\n" + noise(rng.randint(0, 40)) + " " + passage + " " + noise(rng.randint(0, 40))) for i in range(12)]
    for i in range(12, 24):
        w = list(line)
        if i % 2:
            w[rng.randrange(120)] = "Other"
        docs.append((i, noise(20) + "\n" + " ".join(w).upper() + "\nshort line"))
    wrapped = noise(70).split()
    for i in range(30, 34):  # lines of ten words, paragraphs between blank lines
        block = "\n".join(" ".join(wrapped[k : k + 10 + i % 3]) for k in range(0, 70, 10 + i % 3))
        docs.append((i, f"{noise(25)}\nshort\n \n{block}\n\n\n{noise(9)}\n{noise(9)}"))
    docs += [(50, None), (51, ""), (52, "short line"), (53, "x " * 3000), (54, noise(50_000)), (55, "é " * 20), (56, "clean " + noise(80))]
    df = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, first int, bands string")
    rows = paragraphs.duplicates(df).collect()
    check(docs, rows)
    assert {r.doc_id for r in rows} == set(range(24)) | set(range(30, 34)) | {53}
    later = [d for d in range(1, 12) if all(r._removed for r in rows if r.doc_id == d)]
    assert len(later) >= 7
    for d in later:  # the whole passage goes, word by word, where none of its segments stands first
        text = dict(docs)[d].encode()
        start, gone = text.index(passage.encode()), {i for r in rows if r.doc_id == d and r._removed for i in range(r._first, r._end)}
        assert all(start + m.start() in gone and start + m.end() - 1 in gone for m in re.finditer(rb"\S+", passage.encode()))
    cut = {r.doc_id: r.text for r in paragraphs.remove_spans(df, paragraphs.duplicates(df)).collect()}
    assert len(cut) == len(docs) and cut[50] is None and cut[56] == dict(docs)[56] and cut[0] == dict(docs)[0] and len(cut[5]) < len(dict(docs)[5])
    odd = spark.createDataFrame([(1, passage), (1, passage), (None, "a " + passage)], "doc_id long, text string")
    assert {r.doc_id for r in paragraphs.duplicates(odd).collect()} == {1, None}
    assert paragraphs.duplicates(df.limit(0)).count() == 0


def test_remove_spans_of_any_ids(spark):
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"first\n{line}"), (None, f"second\n{line}"), (None, "third"), (None, f"{line}\nfourth"), (7, line), (7, f"fifth\n{line}"), (8, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, _spans string")
    got = paragraphs.remove_spans(df, paragraphs.duplicates(df))
    assert got.columns == df.columns
    left = sorted(str(r.text) for r in got.collect())
    assert len(left) == 7 and sum(line in t for t in left) == 1 and {"third", "None"} <= set(left)
    twice = spark.createDataFrame([(3, line), (3, line)], "doc_id long, text string")
    assert [r.text for r in paragraphs.remove_spans(twice, paragraphs.duplicates(twice)).collect()] == [line, line]


def test_template_family(spark):
    rng = random.Random(6)
    noise = lambda n: [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    template, docs = noise(170), []
    for i in range(120):
        own = noise(30)
        docs += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:10] + noise(20)))]
    df = spark.createDataFrame(docs, "doc long, text string")
    found = paragraphs.near_paragraphs(df, paragraphs.packed(df), 0.8, 16).collect()
    want = brute_paragraphs(docs)
    groups = {}
    for r in found:
        groups.setdefault((r.class_doc, r.class_first), []).append((r.doc, r.first, r.end))
    assert sorted(sorted(g) for g in groups.values()) == want and len(want) == 120


def test_lines_are_found_across_texts_with_and_without_blank_lines(spark):
    rng = random.Random(12)
    noise = lambda n: [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    docs = []
    for i in range(40):
        line = noise(40)
        near = [*line]
        near[1] = "other"
        docs += [(2 * i, " ".join(noise(20)) + "\n" + " ".join(line)), (2 * i + 1, "title\n\n" + " ".join(noise(18)) + "\n" + " ".join(near) + "\n" + " ".join(noise(18)))]
    # a block that goes takes its lines along: they are no first place of anything
    block = [" ".join(noise(30)) for _ in range(3)]
    docs += [(100, "a\n\n" + "\n".join(block)), (101, "b\n\n" + "\n".join([block[0], block[1] + " more", block[2]])), (102, " ".join(noise(17)) + "\n" + block[1] + " more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = paragraphs.duplicates(df).collect()
    want = brute_paragraphs(docs)
    assert classes(rows, "paragraph") == want
    assert sum(len(g) == 2 and g[0][0] + 1 == g[1][0] < 80 for g in want) == 40
    text = {r.doc_id: r.text for r in paragraphs.remove_spans(df, paragraphs.duplicates(df)).collect()}
    everything = " ".join(text.values())
    assert all(w in everything for _, t in docs for w in t.split() if w.startswith("n"))


def test_nothing_is_worked_out_twice(spark, monkeypatch):
    rng = random.Random(13)
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**9)}" for _ in range(n))
    passage, plans, sets = noise(90), [], []
    df = spark.createDataFrame([(i, f"{noise(20)} {passage} {noise(20)}") for i in range(5)], "doc_id long, text string")
    stored, shingle_sets = paragraphs.stored, paragraphs.shingle_sets
    monkeypatch.setattr(paragraphs, "stored", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or stored(x))
    monkeypatch.setattr(paragraphs, "shingle_sets", lambda *a: sets.append(a) or shingle_sets(*a))
    check([(r.doc_id, r.text) for r in df.collect()], paragraphs.duplicates(df).collect())
    assert len(sets) == 1  # the second comparison is among paragraphs of the first
    assert sum(len(re.findall(r"(?m)^[^(]*ArrowEvalPython.*common", p)) for p in plans) == 1
    (of_segments,) = [p for p in plans if "min_by(" in p]
    assert "SortAggregate" not in of_segments and "HashAggregate" in of_segments


def test_cuts_of_many_texts_at_once():
    rng = np.random.Generator(np.random.PCG64(3))
    sizes = [0, 5, 20, 21, 22, 400, 1, 3000, 40]
    texts = [rng.integers(0, 50, n).astype(np.uint64) for n in sizes]
    who = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        together = paragraphs.cut_places(np.concatenate(texts), who)
        want, at = [], 0
        for words in texts:
            pair = paragraphs.mix(words[:-1] * paragraphs.A[0] + words[1:]) >> np.uint64(24)
            want += sorted({at + i + int(np.argmin(pair[i : i + paragraphs.PAIRS])) + 1 for i in range(len(pair) - paragraphs.PAIRS + 1)})
            at += len(words)
        x = rng.integers(0, 2**63, 100).astype(np.uint64)
        assert (paragraphs.mix_in_place(x.copy(), np.empty_like(x)) == paragraphs.mix(x)).all()
    assert together.tolist() == want and len(want) > 200
    text, h, n = rng.integers(0, 3, 300), rng.integers(0, 20, 300), rng.integers(1, 3, 300)
    text.sort()
    keys = list(zip(text.tolist(), h.tolist(), n.tolist(), strict=True))
    assert paragraphs.seen_before(text, h, n).tolist() == [k in keys[:i] for i, k in enumerate(keys)]
