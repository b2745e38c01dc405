import random
import zlib

import numpy as np

from tests.conftest import SF
from webloom.llm import packing, queries, token_files, tokens

DOCS = "doc_id long, text string, piece string, length string, shard string"


def plain_ids(text):
    t = tokens.encoder(tokens.default_tokenizer()).tokenizer
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def docs(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a  b \n c", "x. Y\nz " * 2500, "é日本 ok", "same", "same"] + [" ".join(rng.choice(["the", "ou", "ndst,", "er."]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    return [(None if i == 2 else i, t, "p", "l", "s") for i, t in enumerate(texts)] + [(9, "twice", "", "", "")]


def test_segments_equal_whole_texts():
    rng = random.Random(5)
    enc = tokens.encoder(tokens.default_tokenizer())
    texts = ["".join(rng.choice(["a", "Bé", " ", "  ", "\n", ".", ",", "'s", "12", "²", "\t", "日", " x", "_", " "]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert list(enc.encode_all(texts)) == [enc._whole(t) for t in texts]


def test_pack(spark):
    rows = docs(spark)
    got = packing.pack(packing.cut_pieces(spark.createDataFrame(rows, DOCS))).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        if i == 9:
            continue
        ids, at = plain_ids(text), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= 1 + 1.1 * sum(r.length for r in got) / 1024


def test_plan_covers_every_rank():
    rng = random.Random(1)
    for _ in range(20):
        hist = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(20)}
        slots, used = packing.best_fit_plan(hist, 64)
        room = [0] * used
        for length, n in hist.items():
            ranks = sorted((s[1], s[2]) for s in slots if s[0] == length)
            at = 0
            for start, count in ranks:
                assert start == at
                at += count
            assert at == n
        for length, _, count, first, _ in slots:
            for k in range(count):
                room[first + k] += length
        assert max(room) <= 64
        bins = []  # best fit, piece by piece
        for length in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
            fit = [i for i, r in enumerate(bins) if r >= length]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= length
            else:
                bins.append(64 - length)
        assert used == len(bins)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(packing.cut_pieces(empty)).count() == 0
    files = token_files.TokenFiles.write(empty)
    assert files.starts(files.read(files.locate(files.meta()))).count() == 0


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 7, 500, 4096):
        keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        slots = token_files.slots_of(keys, token_files.build_mph(keys), n)
        assert sorted(slots.tolist()) == list(range(n))


def test_token_files(spark):
    rows = docs(spark)
    files = token_files.TokenFiles.write(spark.createDataFrame(rows, DOCS), bucket_keys=8)
    got = files.starts(files.read(files.locate(files.meta()), with_ids=True)).orderBy("start").collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    by_id = {r.doc_id: r.ids for r in got if r.doc_id != 9}
    assert all(by_id[i] == plain_ids(t) for i, t, *_ in rows if i != 9)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    missing = files.locate(spark.createDataFrame([(10**12,)], "doc_id long"))
    assert missing.count() == 0


def test_queries(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_token_files(spark, SF).orderBy("doc_id").collect()
    at = 0
    for r in got:
        ids = plain_ids(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    packed = queries.op2_best_fit_packing(spark, SF).collect()
    by_doc, seqs = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids, at_ = plain_ids(texts[doc_id]), 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at_, crc(ids[at_ : at_ + r.length]))
            assert len(ids) > 1024 or k == 0
            assert k == 0 or r.length == 1024
            at_ += r.length
        assert at_ == len(ids)
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(seqs) <= -(-at // 1024) + 1  # one more than any packing needs


def test_ids_are_those_of_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    fresh = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext| >", ""] + ["".join(rng.choice(["a", " ", "\n", "<|endoftext|>", " Bé", "<|", "the"]) for _ in range(rng.randint(0, 20))) for _ in range(500)]
    want = [np.asarray(fresh.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(tokens.encoder(path).encode_all(texts)) == want
    assert np.frombuffer(want[0], dtype="<u4").tolist() == [64, 220, 50256, 275]


def test_cache_is_bounded():
    limit = 400_000
    enc = tokens.TextEncoder(tokens.default_tokenizer(), limit)
    fresh = tokens.TextEncoder(tokens.default_tokenizer())
    many = " ".join(f"w{i}x" for i in range(50_000))
    texts = [many, "z" * 100_000 + " " + "q" * 500, many[: 200_000]]
    assert list(enc.encode_all(texts)) == [fresh._whole(t) for t in texts]
    for known in (enc.first, enc.rest):
        for held in (known, known.old):
            assert sum(tokens.ENTRY_BYTES + len(k) + len(v) for k, v in held.items()) <= limit
            assert max(map(len, held), default=0) < tokens.LONG


def test_new_segments_are_encoded_together(monkeypatch):
    calls, own = [], tokens.SegmentIds._ids
    monkeypatch.setattr(tokens.SegmentIds, "_ids", lambda self, texts: calls.append(len(texts)) or own(self, texts))
    enc = tokens.TextEncoder(tokens.default_tokenizer())
    words = [f"w{i}{end}" for i in range(2000) for end in ("", ".\n", "'s", "日\n\n", "² x")]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    odd = ["a \x1cb", "a  b", "a \x85b c", "a ​b", "a\n b", "a ", "日 本"]
    assert list(enc.encode_all(texts + odd + texts)) == [enc._whole(t) for t in texts + odd + texts]
    assert len(calls) < len(words) / 100
