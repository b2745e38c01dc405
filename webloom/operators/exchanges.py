"""Logs of exchanges: of what was recorded several times, the latest at or before a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, *keys: str, at: Column | str | None = None, whole: bool = False) -> DataFrame:
    """`log` without recorded_at and version: of each key the row recorded last, at or before `at` where that is given; of rows of
    one time the one of greatest version. With `whole`, all rows of that time and version (a name's addresses). Rows without
    a time count as the oldest. A table that has no time is no log and stays as it is.

    The rows are dealt out by the key that the plans join by, so that the join finds them in place."""
    if "recorded_at" not in log.columns:
        return log
    rest = [c for c in log.columns if c not in ("recorded_at", "version")]
    if at is not None:
        log = log.filter(F.col("recorded_at").isNull() | (F.col("recorded_at") <= (F.lit(at).cast("timestamp") if isinstance(at, str) else at)))
    version = F.col("version") if "version" in log.columns else F.lit(None).cast("string")
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("recorded_at"), F.desc_nulls_last(version))
    rank = F.rank() if whole else F.row_number()
    return log.withColumn("_rank", rank.over(order)).filter("_rank = 1").select(*rest)
