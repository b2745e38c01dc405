"""Best-fit packing of token pieces into sequences, planned over a histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import gathered, in_small_batches, local_table, quoted, slices, stored
from webloom.llm.tokens import CACHE_BYTES, default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = 1024, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and yields the end id alone. A document of more than `capacity`
    ids is cut; what is left over by the cut is its first piece, all others are full. Other columns
    of `docs` are not read. Repeated rows yield repeated pieces. A worker keeps ids of text segments in `cache_bytes`: less
    memory takes more time."""
    path = tokenizer_path or default_tokenizer()

    def run(batches):
        enc = encoder(path, cache_bytes)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in gathered(slices(batches, keep=("tokens", path, cache_bytes)), enc.group_bytes):
            out = [], [], [], [], []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(t or "" for t in batch.column(1).to_pylist()), strict=True):
                ids += end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    for column, x in zip(out, (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")).mapInArrow(run, PIECES)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, rank_start, count, sequence_start, offset) and the number of sequences.

    Lengths go from long to short; each length's whole count goes at once to the open sequences with
    the least room that it fits. Sequences that hold the same are one entry with a count, so the
    work depends on the number of lengths (at most `capacity`), not of pieces."""
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    rooms: list[int] = []
    used = 0

    def leave(room: int, first: int, count: int) -> None:
        if room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                take = min(left, count)
                if take < count:
                    leave(room, first + take, count - take)
            else:
                room, first = capacity, used
                # a new sequence takes as many of this length as it holds
                each = capacity // length
                if left >= each:
                    take = left // each
                    for k in range(each):
                        slots.append((length, rank, take, first, k * length))
                        rank += take
                    left -= take * each
                    used += take
                    leave(capacity - each * length, first, take)
                    continue
                take = 1
                used += 1
            slots.append((length, rank, take, first, capacity - room))
            rank += take
            left -= take
            leave(room - length, first, take)
    return slots, used


@in_small_batches
def pack(pieces: DataFrame, capacity: int = 1024, blocks: int = 1024) -> DataFrame:
    """`pieces` (see cut_pieces) with sequence_id and offset.

    The driver sees the histogram only (at most `capacity` rows). Pieces of one length are ranked in
    blocks of about 1/`blocks` of all pieces, so a length that many pieces share is ranked by many
    tasks; planned slots and blocks are a few thousand rows at any input size. Equal rows share no
    slot: ties are broken by all columns. An empty table gives an empty result."""
    spark = pieces.sparkSession
    pieces = stored(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if histogram and (max(histogram) > capacity or min(histogram) < 1):
        raise ValueError(f"a piece is not of 1 to {capacity} ids")
    slots, _ = best_fit_plan(histogram, capacity)
    total = sum(histogram.values())
    deals = [(length, max(1, -(-n * blocks // total))) for length, n in histogram.items()]
    dealt = pieces.join(F.broadcast(local_table(spark, deals, "length long, n_blocks int")), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), "n_blocks").cast("int"))
    counts: dict[int, dict[int, int]] = {}
    for length, block, n in dealt.groupBy("length", "block").count().collect():  # at most blocks + capacity rows
        counts.setdefault(length, {})[block] = n
    before = []
    for length, by_block in counts.items():
        at = 0
        for block in sorted(by_block):
            before.append((length, block, at))
            at += by_block[block]
    in_block = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("in_block", F.row_number().over(in_block)).join(F.broadcast(local_table(spark, before, "length long, block int, before long")), ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_block") - 1)
    plan = local_table(spark, slots, "slot_length long, rank_start long, slots long, sequence_start long, offset long")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_start")) & (F.col("rank") < F.col("rank_start") + F.col("slots"))
    return ranked.join(F.broadcast(plan), fits).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_start") + F.col("rank") - F.col("rank_start")).alias("sequence_id"), "offset")
