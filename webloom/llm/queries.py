"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, language_id, lines, near_dedup, oracles, packing, paragraphs, phrases, pii, ranked_search, repeats, tiff, token_files, toxicity
from webloom.llm.common import documents, held_out, small_batches, stored, table


def _small(df: DataFrame) -> DataFrame:
    """A query's few columns, computed in small batches."""
    with small_batches(df.sparkSession):
        return stored(df)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removed_spans(documents(spark, sf_dir))
    return _small(found.select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        (F.col("_n_bytes") - F.octet_length("_kept")).alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    ))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(documents(spark, sf_dir)))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        media = stored(tiff.store_texts(documents(spark, sf_dir)))
    found = tiff.read_texts(media)
    return _small(found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    ))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.char_length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.TokenFiles.write(documents(spark, sf_dir))
    found = files.starts(files.read(files.locate(files.meta())))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.col("_kind").alias("kind"),
        F.col("_first").alias("first_byte"),
        F.col("_end").alias("end_byte"),
        F.col("_n_words").alias("n_words"),
        F.col("_class_id").alias("class_id"),
        F.col("_class_first").alias("class_first_byte"),
        F.col("_removed").alias("removed"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return _small(found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_rows")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = toxicity.score(docs, model)
    return _small(found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [F.expr(f"CAST(size(filter(_base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    return _small(found.select("doc_id", *counts, F.sha2(pii.spelled("_base"), 256).alias("base_sha256"), pii.spelled("_spans").alias("spans")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.RankedIndex.build(documents(spark, sf_dir))
    found = index.search(table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op4_line_dedup": lines.ORACLE,
        "op8_decontamination": decontaminate.ORACLE,
        "op9_minhash_near_dedup": oracles.NEAR_DEDUP,
        "op12_ranked_search": ranked_search.ORACLE,
        "op13_phrase_mining": phrases.ORACLE,
    }
