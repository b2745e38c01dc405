"""What the operators of this subpackage share: the shared folder, hold-out rule, column access."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a session in one process (local tests) gets a temporary folder, set once; on a cluster,
    whose machines would each have their own, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/webloom-{uuid.uuid4().hex}"


#: Rows of an Arrow batch, and of a part of one, while texts are processed.
BATCH_ROWS = 500


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows for what is run inside: ten thousand rows, Spark's default, are meant for short rows; of
    texts or shingle sets they take hundreds of megabytes on both sides. The setting is put back, whatever it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before))) if int(before) > 0 else str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_small_batches(f):
    """f(df, ...) inside small_batches of df's session: for functions that run jobs, not for what they return unread."""

    @wraps(f)
    def run(df: DataFrame, *args, **kwargs):
        with small_batches(df.sparkSession):
            return f(df, *args, **kwargs)

    return run


def slices(batches, rows: int = BATCH_ROWS, keep=None):
    """Arrow batches in parts of `rows` rows, whatever their size. The worker lets go of what operators other than `keep` have
    kept in it (see worker_cache)."""
    if others := [x for x in _held if x != keep]:
        for owner in others:
            del _held[owner]
        pa.default_memory_pool().release_unused()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def gathered(batches, size: int):
    """Arrow batches put together until they hold `size` bytes: for work that shares something among many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and what
    follows survives the loss of any executor."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(f"{folder}/table")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
    out.stored_in = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a DataFrame; by way of Arrow, so that no Python worker is started for them."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(list(c), types[t]) for (n, t), c in zip(fields, columns, strict=True)}), schema)


def run_once(f, schema: str, kind=F.pandas_udf):
    """A UDF that Spark does not move and so does not run twice: a filter on its result would else be computed apart."""
    return kind(f, schema).asNondeterministic()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores behind as it takes to be none of `columns` (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns if c not in without]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def least_hashed(keys: DataFrame, n: int, max_total: int | None = None) -> DataFrame:
    """(label, h) of at most `n` rows of each label, those of least h, from distinct rows (label, h) with h >= 0; with
    `max_total`, of at most about that many rows in all, shared out evenly.

    Counts by label and binary digits of h tell up to which length of h a label has enough; only those rows, about twice
    as many as wanted, are ranked."""
    digits = F.length(F.bin("h"))
    by_label: dict = {}
    for label, length, count in keys.groupBy("label", digits.alias("digits")).count().collect():  # at most 64 rows a label
        by_label.setdefault(label, {})[length] = count
    if max_total and by_label:
        n = max(1, min(n, max_total // len(by_label)))
    tops = []
    for label, counts in by_label.items():
        total = 0
        for length in sorted(counts):
            total += counts[length]
            if total >= n:
                break
        tops.append((label, length))
    top = local_table(keys.sparkSession, tops, f"label {dict(keys.dtypes)['label']}, top int")
    near = keys.join(F.broadcast(top), "label").filter(digits <= F.col("top"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return near.select("label", "h", rank.alias("r")).filter(F.col("r") <= n).select("label", "h")


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def worker_cache(owner, make):
    """What an operator keeps in a Python worker between tasks. A worker serves one operator after another: it keeps
    the last one's things only, so that their memory does not add up."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]
