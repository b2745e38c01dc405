"""Whole-text encoding with the tokenizers library, sped up by a bounded cache of text segments.

A byte-level BPE vocabulary of this kind splits a text before every space that a non-space
character follows. Where a text has no other kind of space and no added token of the file, its pieces between spaces can be
encoded apart and joined; a worker keeps what it has encoded, and encodes what it lacks by hundreds. Any other text, and any other
kind of tokenizer, is encoded whole. Both ways give the ids of a whole-text call."""

from __future__ import annotations

import os
from collections.abc import Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from webloom.llm.common import worker_cache

#: Bytes that a worker's cache may take: a bound on memory, not on results.
CACHE_BYTES = 128_000_000
#: What an entry takes besides its bytes (offsets, and a hash table while it is looked up), and the bytes from which on a
#: segment is not kept.
ENTRY_BYTES, LONG = 48, 64
#: Segments and bytes of a call of the library; texts whose segments are told apart together are this part of the cache.
CALL_SEGMENTS, CALL_BYTES, GROUP_PART = 200, 1 << 16, 32


def byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = byte_alphabet()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Segments(Mapping):
    """segment without its leading space -> ids as little-endian unsigned 32-bit bytes, as two Arrow arrays."""

    def __init__(self, words=None, ids=None):
        self.words = pa.array([], pa.large_string()) if words is None else words
        self.ids = pa.array([], pa.large_binary()) if ids is None else ids

    def __len__(self):
        return len(self.words)

    def __iter__(self):
        return iter(self.words.to_pylist())

    def __getitem__(self, segment: str) -> bytes:
        at = pc.index_in(pa.scalar(segment, pa.large_string()), self.words).as_py()
        if at is None:
            raise KeyError(segment)
        return self.ids[at].as_py()


class SegmentIds(Segments):
    """What a worker has encoded; of() encodes what it lacks.

    It keeps two generations of half of `limit` bytes each: when the new one is full it becomes the old one, from
    which a segment that comes again returns. Long segments are not kept."""

    def __init__(self, tokenizer, limit: int, lead: str = "", begins: np.ndarray | None = None):
        super().__init__()
        self.tokenizer, self.lead, self.begins = tokenizer, lead, begins
        self.half, self.old = limit // 2, Segments()

    def of(self, segments: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct segments, none of which begins with white space if `lead` is a space."""
        at = positions(segments, self.words)
        lost = np.flatnonzero(at < 0)
        before = positions(segments.take(pa.array(lost)), self.old.words)
        back, new = lost[before >= 0], lost[before < 0]
        at[back] = len(self) + np.arange(len(back))
        at[new] = len(self) + len(back) + np.arange(len(new))
        unknown = segments.take(pa.array(new))
        words = pa.concat_arrays([self.words, segments.take(pa.array(back)), unknown])
        ids = pa.concat_arrays([self.ids, self.old.ids.take(pa.array(before[before >= 0])), self._encode(unknown)])
        self._keep(words, ids)
        return ids.take(pa.array(at))

    def _keep(self, words: pa.LargeStringArray, ids: pa.LargeBinaryArray) -> None:
        short = pc.less(pc.binary_length(words), LONG)
        words, ids = words.filter(short), ids.filter(short)
        size = np.cumsum((pc.binary_length(words).to_numpy() + pc.binary_length(ids).to_numpy() + ENTRY_BYTES)[::-1])
        n = int(np.searchsorted(size, self.half, side="right"))
        if n < len(words):
            self.old = Segments(pa.concat_arrays([words[len(words) - n :]]), pa.concat_arrays([ids[len(ids) - n :]]))
            words, ids = words[:0], ids[:0]
        self.words, self.ids = words, ids

    def _encode(self, segments: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Many in one call, as one text: only the first id of each segment stands for a space and what follows it."""
        ends = np.cumsum(pc.binary_length(segments).to_numpy())
        bounds = [0]
        while bounds[-1] < len(segments):
            most = (ends[bounds[-1] - 1] if bounds[-1] else 0) + CALL_BYTES
            bounds.append(max(bounds[-1] + 1, min(bounds[-1] + CALL_SEGMENTS, int(np.searchsorted(ends, most, side="right")))))
        parts, at, size = [], [np.zeros(1, dtype=np.int64)], 0
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), segments), pa.scalar(self.lead, pa.large_string())).to_pylist()
        for text, (a, b) in zip(texts, pairwise(bounds), strict=True):
            for ids, first in self._call(text, segments[a:b]):
                parts.append(ids)
                at.append(np.append(first[1:], len(ids)) + size)
                size += len(ids)
        offsets = 4 * np.concatenate(at)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(segments), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.zeros(0, "<u4"), *parts]))])

    def _call(self, text: str, segments: pa.LargeStringArray):
        """(ids, places at which segments begin) of one or, joined as `text`, all of the segments at a time."""
        if self.lead:
            ids = np.asarray(self._ids([self.lead + text])[0], dtype="<u4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(segments) and not first[0]:
                return [(ids, first)]
        return [(np.asarray(ids, dtype="<u4"), np.zeros(1, dtype=np.int64)) for ids in self._ids([self.lead + x for x in segments.to_pylist()])]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def positions(words: pa.LargeStringArray, known: pa.LargeStringArray) -> np.ndarray:
    """Where the words stand among the known ones; -1 for the others."""
    return pc.index_in(words, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def begins_with_space(words: pa.LargeStringArray) -> np.ndarray:
    """Whether a word is empty or begins with white space, of any kind that Python knows."""
    length, offsets = pc.binary_length(words).to_numpy(), np.frombuffer(words.buffers()[1], dtype="<i8")[words.offset :]
    out = length == 0
    full = np.flatnonzero(~out)
    first = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[full]]
    odd = full[(first <= 32) | (first > 127)]
    letters = pc.utf8_slice_codeunits(words.take(pa.array(odd)), 0, 1).dictionary_encode()
    out[odd] = np.array([x.isspace() for x in letters.dictionary.to_pylist()], dtype=bool)[letters.indices.to_numpy()]
    return out


class TextEncoder:
    """encode_all(texts) -> for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.group_bytes = limit // GROUP_PART
        self.added = [token.content for token in t.get_added_tokens_decoder().values()]
        kind = repr(t.pre_tokenizer)
        self.by_segment = t.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        if self.by_segment:
            ids = t.get_vocab()
            begins = np.zeros(max(ids.values(), default=0) + 1, dtype=bool)
            begins[[i for token, i in ids.items() if token.startswith(BYTES[32])]] = True
            self.first = SegmentIds(t, limit // 8)
            self.rest = SegmentIds(t, limit - limit // 8, " ", begins)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_all(self, texts):
        """A generator; texts of `group_bytes` characters, or one longer text, in memory at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= self.group_bytes:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]):
        """Segments are cut, told apart and put together again by Arrow, so that each is looked up once a group."""
        if not self.by_segment:
            yield from map(self._whole, texts)
            return
        apart = [not any(content in text for content in self.added) for text in texts]
        ends = [text.partition(" ") if ok else ("", "", "") for text, ok in zip(texts, apart, strict=True)]
        cut = [i for i, (_, space, _) in enumerate(ends) if space]
        words = pc.split_pattern(pa.array([ends[i][2] for i in cut], pa.large_string()), " ")
        bounds, named = words.offsets.to_numpy(), words.values.dictionary_encode()
        # a space before other white space or at the end: such a text is encoded whole
        other = begins_with_space(named.dictionary)
        before = np.concatenate([[0], np.cumsum(other[named.indices.to_numpy()])])[bounds]
        for i in np.flatnonzero(np.diff(before)):
            apart[cut[i]] = False
        place = np.cumsum(~other) - 1
        ids = self.rest.of(named.dictionary.filter(pa.array(~other))).take(pa.array(place[named.indices.to_numpy()], mask=other[named.indices.to_numpy()]))
        at, data = np.frombuffer(ids.buffers()[1] or bytes(8), dtype="<i8")[bounds].tolist(), memoryview(ids.buffers()[2] or b"")
        between = dict(zip(cut, pairwise(at), strict=True))
        del words, named, other, before, place, bounds
        pa.default_memory_pool().release_unused()
        heads = pa.array(sorted({head for (head, _, _), ok in zip(ends, apart, strict=True) if ok and head}), pa.large_string())
        of_head = dict(zip(heads.to_pylist(), self.first.of(heads).to_pylist(), strict=True))
        for i, (text, ok, (head, _, _)) in enumerate(zip(texts, apart, ends, strict=True)):
            a, b = between.get(i, (0, 0))
            yield of_head.get(head, b"") + data[a:b] if ok else self._whole(text)


def encoder(path: str, limit: int = CACHE_BYTES) -> TextEncoder:
    """One encoder for each worker process, vocabulary file and cache."""
    return worker_cache(("tokens", path, limit), lambda: TextEncoder(path, limit))
