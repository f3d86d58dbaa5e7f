"""Training corpus in five stages: rules, classifier, near duplicates, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import mixing, near_duplicates, packing, quality_classifier, quality_rules
from frostline.llm.queries import tokenizer_files
from frostline.session import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the filter's threshold table."""
    return quality_rules.passed(docs, quality_rules.FILTER_RULES, description="text")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3.

    The model learns from the given marks of all documents, those that the rules have removed too: what the rules let
    pass holds few marks of the other kind.
    """
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.train_quality(every, marks, event_id="doc_id", description="text", mark="quality")
    scored = quality_classifier.score_quality(docs, model, description="text")
    return scored.where("quality_score >= 0.3").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return near_duplicates.without_copies(docs, event_id="doc_id", description="text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, half way from the given shares to equal ones, the smallest sources up to twice."""
    mixed = mixing.mix_sources(docs, max_repeats=2.0, evenness=mixing.EVENNESS, event_id="doc_id", source="source", description="text")
    return mixed.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 1024 tokens."""
    path, ranks = tokenizer_files()
    packed = packing.pack_events(docs, path, event_id="doc_id", description="text", ranks_path=ranks)
    return packed.withColumnRenamed("event_id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Two stages are trained and one searches with sketches, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
