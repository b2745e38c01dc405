"""Recorded sources: exchanges kept as Parquet, in the schemas of webloom.schemas, as a log: what is recorded again is added, and
readers take the latest of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.operators.exchanges import latest

TABLES = {"responses": schemas.HTTP_RESPONSE, "rendered": schemas.RENDERED, "resolved": schemas.RESOLVED, "api": schemas.API_RESPONSE, "messages": schemas.MESSAGES, "users": schemas.USERS, "channels": schemas.CHANNELS, "search": "search_query string, status int, body string"}
#: What an exchange is known by; the rows of a name's addresses belong together.
KEYS = {"responses": ("url",), "rendered": ("url",), "resolved": ("host",), "api": ("path",), "messages": ("channel", "thread_ts", "ts"), "users": ("user",), "channels": ("channel",), "search": ("search_query",)}
WHOLE = ("resolved",)
VERSION = "recorded_at timestamp, version string"


def log(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All that was recorded, with its time and version; both are null in tables of earlier releases."""
    return spark.read.schema(f"{TABLES[table]}, {VERSION}").parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str, table: str, at: Column | str | None = None) -> DataFrame:
    """The latest exchange of each key, at or before `at` where that is given."""
    return latest(log(spark, folder, table), *KEYS[table], at=at, whole=table in WHOLE)


def write(df: DataFrame, folder: str, table: str, at: Column | None = None) -> None:
    """Adds exchanges, recorded now or `at`, so that a crawl can be continued or repeated."""
    rows = df.sparkSession.createDataFrame([], TABLES[table]).unionByName(df)
    version = F.lit(uuid.uuid4().hex) if table in WHOLE else F.expr("uuid()")
    rows.select("*", (F.current_timestamp() if at is None else at.cast("timestamp")).alias("recorded_at"), version.alias("version")).write.mode("append").parquet(f"{folder}/{table}")


def compact(spark: SparkSession, folder: str, table: str, into: str) -> None:
    """Writes a log's latest exchanges to the same table of another folder, with a time before anything that is added later."""
    rows = log(spark, folder, table)
    found = latest(rows.withColumn("_at", F.col("recorded_at")).withColumn("_version", F.col("version")), *KEYS[table], whole=table in WHOLE)
    found.withColumnsRenamed({"_at": "recorded_at", "_version": "version"}).write.mode("error").parquet(f"{into}/{table}")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
