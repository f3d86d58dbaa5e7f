"""Columns of any name pass through the operators that work in Arrow batches."""

import pytest
from pyspark.sql import functions as F

from frostline.llm import html_extraction, near_duplicates, quality_classifier
from tests.llm.samples import descriptions, events

NAMES = ["a.b", "__text", "__page", "copy_id", "again_id", "row", "key", "c0", "in_text", "in_page", "out0", "text_digest",
         "copy_digest", "odd `name`", "digest"]


def named(df):
    for name in NAMES:
        df = df.withColumn(name.replace("`", "``") if False else name, F.lit(f"given {name}"))
    return df


def kept(df):
    first = df.first().asDict()
    return all(first[name] == f"given {name}" for name in NAMES)


def test_quality_scores(spark):
    df = named(events(spark, clash=False))
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "event_id long, useful int")
    got = quality_classifier.score_quality(df, quality_classifier.train_quality(df, marks))
    assert got.columns == [*df.columns, "quality_score"] and kept(got) and got.count() == len(descriptions())


def test_pages(spark):
    df = named(spark.createDataFrame([("u", "<p>Snow is falling on the roads of the county today.</p>")], "url string, html string"))
    got = html_extraction.release_texts(df)
    assert got.columns == [*df.columns, "text"] and kept(got)


@pytest.mark.parametrize("copies", [1, 2])
def test_one_of_each_group(spark, copies):
    rows = [(1, "snow on the ramp of route 28 near etna"), (2, "snow on the ramp of route 28 near etna"), (3, "ice")] * copies
    df = named(events(spark, rows, clash=False))
    got = near_duplicates.without_copies(df)
    assert got.columns == df.columns and kept(got)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 3]
