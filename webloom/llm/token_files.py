"""Binary token output: raw id payloads in shards, found by key through a minimal perfect hash index.

Payload `ids-*.bin`: little-endian unsigned ids, 16 bits each where the vocabulary allows, else 32,
without any header; documents follow each other in ascending doc_id order, shards too.
Index (Parquet, one row per bucket of about `bucket_keys` keys): pilots of a hash-and-displace minimal
perfect hash, and for each slot its entries' fingerprint, shard, first id and number of ids.
A lookup computes bucket and slot, then compares the stored fingerprint: constant time per key."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import gathered, quoted, shared_dir, slices, small_batches
from webloom.llm.tokens import CACHE_BYTES, default_tokenizer, encoder

META = "doc_id long, shard string, first long, n_tokens long"
INDEX = "bucket long, n_slots int, pilots binary, pointers binary, fingerprints binary, shards array<string>, shard_at binary, firsts binary, lengths binary"
FOUND = "doc_id long, shard string, first long, n_tokens long"
#: Bytes of text for a shard, and ids that a task reads back at once.
SHARD_BYTES, READ_IDS = 1 << 27, 1 << 22
#: Multipliers of the public splitmix64 finaliser; they are part of the index format.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray, salt) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(salt, dtype=np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


def key_hash(key: Column) -> Column:
    """64 bits of a key; null is a key like any other."""
    return F.xxhash64(key)


def fingerprint(key: Column) -> Column:
    return F.hash(F.lit("fingerprint"), key)


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash of the distinct 64-bit keys: slot(key) is in 0..n-1, no two alike.

    Keys fall into n/4 groups; from the largest on, a group takes the first pilot that puts its keys
    into free slots. Groups of one key take a free slot by its number (pilot -1-slot)."""
    n = len(keys)
    n_groups = max(1, n // 4)
    group = (mixed(keys, 0) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(n_groups + 1))
    sizes = np.diff(starts)
    pilots = np.zeros(n_groups, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    tries = np.arange(1, 257, dtype=np.uint64)
    for g in np.argsort(-sizes, kind="stable"):
        own = keys[order[starts[g] : starts[g + 1]]]
        if len(own) < 2:
            break
        base = 0
        while True:
            at = (mixed(own[None, :], (tries + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
            fits = free[at].all(axis=1)
            for t in np.flatnonzero(fits):
                if len(set(at[t].tolist())) == len(own):
                    pilots[g] = base + int(tries[t])
                    free[at[t]] = False
                    break
            else:
                base += len(tries)
                continue
            break
    pilots[sizes == 1] = -1 - np.flatnonzero(free)
    return pilots


def slots_of(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    pilot = pilots[(mixed(keys, 0) % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -1 - pilot, (mixed(keys, np.maximum(pilot, 0)) % np.uint64(n)).astype(np.int64))


def build_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's index row from (bucket, key_hash, fingerprint, shard, first, n_tokens)."""
    keys, of = np.unique(rows.key_hash.to_numpy().astype(np.uint64), return_inverse=True)
    pilots = build_mph(keys)
    slot = slots_of(keys, pilots, len(keys))[of]
    rows = rows.assign(slot=slot).sort_values(["slot", "shard", "first"])
    shards, shard_at = np.unique(rows["shard"].to_numpy().astype(str), return_inverse=True)
    pack = lambda x, kind: np.ascontiguousarray(x, dtype=kind).tobytes()
    return pd.DataFrame({
        "bucket": [rows.bucket.iloc[0]], "n_slots": [len(keys)], "pilots": [pack(pilots, "<i8")],
        "pointers": [pack(np.searchsorted(rows.slot.to_numpy(), np.arange(len(keys) + 1)), "<i4")],
        "fingerprints": [pack(rows.fingerprint, "<i4")], "shards": [shards.tolist()], "shard_at": [pack(shard_at, "<i4")],
        "firsts": [pack(rows["first"], "<i8")], "lengths": [pack(rows.n_tokens, "<i8")],
    })


def look_up(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Entries of the keys (doc_id, key_hash, fingerprint) of one bucket in its index row."""
    none = pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "shard": pd.Series(dtype=str), "first": pd.Series(dtype="int64"), "n_tokens": pd.Series(dtype="int64")})
    if index.empty or keys.empty:
        return none
    row = index.iloc[0]
    get = lambda name, kind: np.frombuffer(row[name], dtype=kind)
    pointers, prints, firsts, lengths = get("pointers", "<i4"), get("fingerprints", "<i4"), get("firsts", "<i8"), get("lengths", "<i8")
    slot = slots_of(keys.key_hash.to_numpy().astype(np.uint64), get("pilots", "<i8"), int(row.n_slots))
    counts = (pointers[slot + 1] - pointers[slot]).astype(np.int64)
    who = np.repeat(np.arange(len(keys)), counts)
    entry = np.repeat(pointers[slot].astype(np.int64) - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    same = prints[entry] == keys.fingerprint.to_numpy()[who]
    who, entry = who[same], entry[same]
    shards = np.asarray(row["shards"], dtype=object)
    return pd.DataFrame({"doc_id": keys.doc_id.iloc[who].astype("Int64").array, "shard": shards[get("shard_at", "<i4")[entry]], "first": firsts[entry], "n_tokens": lengths[entry]})


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the session's default file system where it has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def opened(path: str):
    """pyarrow's file system for a path with a scheme, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class TokenFiles:
    """Token files in `path` (any store that pyarrow.fs and Spark both reach) and their index."""

    def __init__(self, spark: SparkSession, path: str, id_bytes: int = 2, bucket_keys: int = 4096):
        self.spark, self.path, self.id_bytes, self.bucket_keys = spark, qualified(spark, path), id_bytes, bucket_keys

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, end_id: int = 2, id_bytes: int = 2, bucket_keys: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
        """Encode `docs`, write payload shards and index.

        A null text counts as empty (its end id alone is stored); rows with a null or repeated doc_id
        are stored too, null first, and share a key. Other columns are not read. Shards are as many as the texts' bytes ask
        for, and at least as many as the session's shuffle partitions. A shard's name is
        in the table of documents only if its task ended, so files of lost tasks are never read."""
        files = cls(docs.sparkSession, path or shared_dir(docs.sparkSession), id_bytes, bucket_keys)
        tok, top, kind = tokenizer_path or default_tokenizer(), files.path, f"<u{id_bytes}"

        def run(batches):
            store, base = opened(f"{top}/ids")
            enc, first, out = encoder(tok), 0, None
            end = np.uint32(end_id).astype("<u4").tobytes()
            name = f"ids-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.bin"
            for batch in gathered(slices(batches, keep=("tokens", tok, CACHE_BYTES)), enc.group_bytes):
                if batch.num_rows and out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                firsts, counts = [], []
                for ids in enc.encode_all(t or "" for t in batch.column(1).to_pylist()):
                    ids = np.frombuffer(ids + end, dtype="<u4")
                    if id_bytes < 4 and int(ids.max()) >> (8 * id_bytes):
                        raise ValueError("an id does not fit id_bytes")
                    out.write(ids.astype(kind).tobytes())
                    firsts.append(first)
                    counts.append(len(ids))
                    first += len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows, pa.string()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "shard", "first", "n_tokens"])
            if out is not None:
                out.close()

        texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n_shards = max(int(files.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
        ranged = texts.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id")
        with small_batches(files.spark):
            ranged.mapInArrow(run, META).write.parquet(f"{files.path}/meta")
        meta = files.meta()
        # a shard's place among all ids: shards are as many as write tasks, not as documents
        shards = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        shards.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "base").write.parquet(f"{files.path}/shards")
        n_buckets = max(1, -(-meta.count() // bucket_keys))
        entries = meta.select(*files._key(n_buckets), "shard", "first", "n_tokens")
        entries.groupBy("bucket").applyInPandas(build_bucket, INDEX).write.parquet(f"{files.path}/index-{n_buckets}")
        files.n_buckets = n_buckets
        return files

    @staticmethod
    def _key(n_buckets: int) -> list[Column]:
        key = F.col("doc_id")
        return [F.pmod(F.shiftright(key_hash(key), 20), F.lit(n_buckets)).alias("bucket"), key_hash(key).alias("key_hash"), fingerprint(key).alias("fingerprint")]

    def meta(self) -> DataFrame:
        return self.spark.read.schema(META).parquet(f"{self.path}/meta")

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, first, n_tokens) of every stored row of the keys, through the index alone."""
        index = self.spark.read.schema(INDEX).parquet(f"{self.path}/index-{self.n_buckets}")
        asked = keys.select(F.col("doc_id").cast("long")).distinct().select("doc_id", *self._key(self.n_buckets))
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(look_up, FOUND)

    def read(self, located: DataFrame, with_ids: bool = False) -> DataFrame:
        """located with ids_crc32 of the stored ids (as unsigned 32-bit) and, if asked, the ids. A group of rows that begin
        within READ_IDS ids of one shard is read in one go, in the order of the file."""
        top, kind, width = self.path, f"<u{self.id_bytes}", self.id_bytes

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            store, base = opened(f"{top}/ids")
            rows = rows.sort_values("first")
            crcs, kept = [], []
            with store.open_input_file(f"{base}/{rows['shard'].iloc[0]}") as f:
                for first, n in zip(rows["first"].tolist(), rows["n_tokens"].tolist(), strict=True):
                    ids = np.frombuffer(f.read_at(n * width, first * width), dtype=kind).astype("<u4").tobytes()
                    crcs.append(zlib.crc32(ids))
                    if with_ids:
                        kept.append(np.frombuffer(ids, dtype="<u4").astype("int64").tolist())
            rows = rows[["doc_id", "shard", "first", "n_tokens"]].assign(ids_crc32=crcs, doc_id=rows.doc_id.astype("Int64"))
            return rows.assign(ids=kept) if with_ids else rows

        groups = located.select("doc_id", "shard", "first", "n_tokens").groupBy("shard", F.floor(F.col("first") / READ_IDS))
        return groups.applyInPandas(run, FOUND + ", ids_crc32 long" + ", ids array<long>" * with_ids)

    def starts(self, read: DataFrame) -> DataFrame:
        """Adds start: the ids of all documents before."""
        shards = self.spark.read.schema("shard string, base long").parquet(f"{self.path}/shards")
        return read.join(shards, "shard").withColumn("start", F.col("base") + F.col("first"))
