"""Queries of the text operators: each maps the driver tables to an operator's columns, and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import (byte_pairs, chat_format, fingerprints, html_extraction, infilling, language_model, license_scan,
                           mixing, near_duplicates, packing, quality_classifier, quality_rules, resampling)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traffic events: the id, the text and where it comes from."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("description"), F.col("source").alias("data_source"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.quality_rules(descriptions(spark, sf_dir).drop("data_source"))
    q = F.col("quality")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return df.select(
        F.col("event_id").alias("doc_id"), *[q[m].alias(m) for m in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & q["kept"]).alias("kept"), q["n_lines"].alias("n_lines"),
        q["n_stop_words"].alias("n_stop_words"), q["n_bare_words"].alias("n_bare_words"),
        F.array_join(q["broken"], ",").alias("broken"))


def remainder(event_id: str, divisor: int):
    """Remainder of the checksum of an id as text."""
    return F.crc32(F.col(event_id).cast("string").cast("binary")) % divisor


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = descriptions(spark, sf_dir).drop("data_source")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("event_id"), F.col("quality").alias("useful")).where(remainder("event_id", 5) != 0)
    df = quality_classifier.score_quality(events, quality_classifier.train_quality(events, marks))
    return df.select(F.col("event_id").alias("doc_id"), (remainder("event_id", 5) == 0).alias("held_out"),
                     F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    df = html_extraction.release_texts(pages)
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = descriptions(spark, sf_dir).drop("data_source").withColumn("train", remainder("event_id", 7) != 2)
    df = language_model.language_scores(events, "train")
    return df.select(F.col("event_id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                     "train_tokens", "base_score", "score")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = descriptions(spark, sf_dir).select("event_id", "description")
    return license_scan.scan_licenses(releases, "event_id", "description").withColumnRenamed("release_id", "doc_id")


def tokenizer_files() -> tuple[str, str]:
    """The byte-level vocabulary, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ranks = tokenizer_files()
    df = packing.pack_events(descriptions(spark, sf_dir), path, ranks_path=ranks)
    return df.withColumnRenamed("event_id", "doc_id")


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mix_sources(descriptions(spark, sf_dir), evenness=mixing.EVENNESS)
    return df.select(F.col("event_id").alias("doc_id"), F.col("data_source").alias("source"), "mix.*")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_duplicates.near_duplicates(descriptions(spark, sf_dir).drop("data_source"), shingle=3, percent=85)
    return df.select(F.col("event_id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprints.edited_fingerprints(descriptions(spark, sf_dir).drop("data_source"))
    return df.select(
        F.col("event_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], given.schema)
    df = chat_format.format_conversations(given.unionByName(extra))
    turns = chat_format.read_back(F.col("formatted"))
    df = df.withColumn("turns", turns).withColumn("loss", chat_format.loss_text(F.col("pieces")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                     F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                     F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = infilling.fill_in_middle(descriptions(spark, sf_dir).drop("data_source"))
    back = infilling.restored(F.col("infill"), F.col("form"))
    return df.select(
        F.col("event_id").alias("doc_id"), F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("infill", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query
def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranks = tokenizer_files()
    df = byte_pairs.encode_descriptions(descriptions(spark, sf_dir).drop("data_source"), ranks, decoded="decoded")
    return df.select(
        F.col("event_id").alias("doc_id"), (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    df = resampling.resample_events(descriptions(spark, sf_dir).drop("data_source"), releases)
    return df.withColumnRenamed("event_id", "doc_id")
