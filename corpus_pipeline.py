"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, language_id, lines, near_dedup, packing
from webloom.llm.common import documents, held_out, stored, table

#: The later stages depend on a trained language model and on signatures, which SQL cannot express; the stages
#: are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those for which no language is likelier than all others together."""
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs, model)
    lang, score, _ = found.columns[len(docs.columns) :]
    return found.filter((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of every text; n_chars follows. Every document stays."""
    kept = lines.drop_boilerplate(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near copies."""
    return near_dedup.keep_one(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, packed into sequences of 1024."""
    # the session's executors have served four stages before: a small cache leaves them room
    return packing.pack(packing.cut_pieces(docs, cache_bytes=32_000_000))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_documents),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
