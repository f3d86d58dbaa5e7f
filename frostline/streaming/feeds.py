"""Incremental feeds: snapshots, alerts and prediction updates.

State is one row per key. Each micro-batch is reduced to the latest row per key before it meets the stored table, and
the stored table is bucketed by key hash, so only touched buckets are rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from frostline.functions import weather
from frostline.functions.risk import probability_label
from frostline.session import new_path, remove_path
from frostline.sources.files import path_exists

BUCKETS = 64
KEPT = 3
FAN_IN = 8


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row per key by the ``order`` columns; an aggregate, so copies of a key are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(latest).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(batch: DataFrame, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Merge a batch into a stored table of one row per key; only buckets the batch touches are read and rewritten.

    The table is a folder of versions and a folder of numbered manifests; a manifest names for each bucket the version
    that holds it. New buckets are written beside the old ones, and one small file, put in place by a rename, makes them
    visible together: a reader sees a batch whole or not at all, and a failed batch leaves the last version as it was and
    can be repeated. Replaying a batch changes nothing. Of two writers with the same number the second fails. The last
    ``KEPT`` manifests and what they name stay, for readers that began before.

    The touched buckets, at most ``buckets`` numbers, choose the files that are read; choose their number by the size of
    the table, a few files' worth each, and keep it.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    reduced, version = new_path(spark, "upsert-batch"), f"v-{uuid.uuid4().hex}"
    try:
        latest_per_key(batch, key, order).withColumn("bucket", bucket).write.parquet(reduced)
        fresh = spark.read.parquet(reduced)
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
        number, manifest = _manifest(spark, path)
        held = manifest["buckets"] if manifest else {}
        old = [f"{path}/data/{held[str(b)]}/bucket={b}" for b in touched if str(b) in held]
        if old:
            stored = spark.read.schema(_schema(manifest)).parquet(*old).withColumn("bucket", bucket)
            fresh = latest_per_key(stored.unionByName(fresh), key, order).withColumn("bucket", bucket)
        fresh.write.partitionBy("bucket").parquet(f"{path}/data/{version}")
        named = held | {str(b): version for b in touched}
        _commit(spark, path, number + 1, {"schema": fresh.drop("bucket").schema.json(), "buckets": named})
        _clean(spark, path, number + 1)
    finally:
        remove_path(spark, reduced)


def _schema(manifest: dict) -> T.StructType:
    return T.StructType.fromJson(json.loads(manifest["schema"]))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The last committed version of an upserted table."""
    _, manifest = _manifest(spark, path)
    schema = _schema(manifest)
    if not manifest["buckets"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{v}/bucket={b}" for b, v in manifest["buckets"].items()])


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are there, in order."""
    if not path_exists(spark, f"{path}/manifests"):
        return []
    names = (s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, f"{path}/manifests")))
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict | None]:
    """The manifest of this number, or the last one, with its number; number 0 and none for a new table."""
    found = _numbers(spark, path)
    if not found:
        return 0, None
    number = found[-1] if number is None else number
    return number, json.loads(spark.read.text(f"{path}/manifests/{number}", wholetext=True).head()["value"])


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Put a manifest in place by a rename, which fails where its number is taken."""
    files, place = _files(spark, path), f"{path}/manifests/{number}"
    begun = _path(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = files.create(begun, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if path_exists(spark, place) or not files.rename(begun, _path(spark, place)):
        files.delete(begun, False)
        raise RuntimeError(f"another batch was committed as {place}")


def _clean(spark: SparkSession, path: str, number: int) -> None:
    """Remove manifests before the last ``KEPT``, and the buckets that only they name; what failed batches left stays."""
    manifests = {n: _manifest(spark, path, n)[1]["buckets"].items() for n in _numbers(spark, path)}
    kept = {place for n, named in manifests.items() if n > number - KEPT for place in named}
    files = _files(spark, path)
    for n, named in manifests.items():
        if n <= number - KEPT:
            for bucket, version in set(named) - kept:
                files.delete(_path(spark, f"{path}/data/{version}/bucket={bucket}"), True)
            files.delete(_path(spark, f"{path}/manifests/{n}"), False)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def append_snapshot_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a batch as a partition of the stored table, in place of what the same batch wrote before."""
    batch.dropDuplicates(["event_id", "last_updated"]).withColumns({
        "fetched_at": F.current_timestamp(), "batch": F.lit(number)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def snapshot_stream(events: DataFrame, path: str, checkpoint: str, compact_every: int | None = None) -> DataStreamWriter:
    """Append each fetched event with its fetch time, however old its update is.

    A batch is a partition of the stored table, so that repeating it replaces its own rows; a (event, update) pair that
    repeats within a batch is kept once. No state grows with the feed. With ``compact_every``, batches are compacted each
    time that many have come, and the table is read by ``read_snapshots``. The table belongs to its checkpoint, which
    numbers the batches.
    """
    def append(batch: DataFrame, number: int) -> None:
        append_snapshot_batch(batch, number, path)
        if compact_every and (number + 1) % compact_every == 0:
            compact_snapshots(batch.sparkSession, path)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch partitions that are there, in order."""
    if not path_exists(spark, path):
        return []
    names = (s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path)))
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _batch_rows(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(*[f"{path}/batch={n}" for n in numbers])


def compact_snapshots(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Put all batches but the newest ``keep`` into segments of few large files; rows and their batch stay as they are.

    A manifest records the segments and the last batch that they hold (``through``). It is put in place by a rename once
    a segment is written, so a reader sees a batch in its partition or in a segment, never in both or in neither; a
    compaction that fails leaves the table as it was. A batch repeated later writes its partition again, which nobody
    reads, since it is not after ``through``. Partitions stay until the next compaction, and segments until ``KEPT`` more,
    for readers that began before.

    Once ``FAN_IN`` segments of a level are there, they become one of the next level. So a row is written once a level, and
    the number of segments grows with the logarithm of the number of batches.
    """
    home = f"{path}/_compacted"
    number, manifest = _manifest(spark, home)
    manifest = manifest or {"through": -1, "segments": []}
    held, found = manifest["through"], _batches(spark, path)
    files = _files(spark, path)
    for n in found:
        if n <= held:
            files.delete(_path(spark, f"{path}/batch={n}"), True)
    fresh = [n for n in found[:len(found) - keep] if n > held]
    if not fresh:
        return
    segments = manifest["segments"]
    rows, level = _batch_rows(spark, path, fresh), 0
    while len(same := [s for s in segments if s["level"] == level]) >= FAN_IN - 1:
        rows = rows.unionByName(_segment_rows(spark, home, same), allowMissingColumns=True)
        segments = [s for s in segments if s["level"] != level]
        level += 1
    version = f"v-{uuid.uuid4().hex}"
    rows.hint("rebalance").write.parquet(f"{home}/data/{version}")
    _commit(spark, home, number + 1, {"through": fresh[-1], "segments": [*segments, {"version": version, "level": level}]})
    manifests = {n: {s["version"] for s in _manifest(spark, home, n)[1]["segments"]} for n in _numbers(spark, home)}
    needed = set().union(*[named for n, named in manifests.items() if n > number + 1 - KEPT])
    for n, named in manifests.items():
        if n <= number + 1 - KEPT:
            for old in named - needed:
                files.delete(_path(spark, f"{home}/data/{old}"), True)
            files.delete(_path(spark, f"{home}/manifests/{n}"), False)


def _segment_rows(spark: SparkSession, home: str, segments: list[dict]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{home}/data/{s['version']}" for s in segments])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a snapshot table, compacted or not, with the batch they came in; columns that a batch lacks are null."""
    _, manifest = _manifest(spark, f"{path}/_compacted")
    manifest = manifest or {"through": -1, "segments": []}
    live = [n for n in _batches(spark, path) if n > manifest["through"]]
    parts = [_batch_rows(spark, path, live)] if live else []
    if manifest["segments"]:
        parts.append(_segment_rows(spark, f"{path}/_compacted", manifest["segments"]))
    if not parts:
        raise FileNotFoundError(f"no snapshot under {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: str, order: list[str]) -> DataStreamWriter:
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: upsert(batch, path, key, order))


def alert_events(alerts: DataFrame, description_chars: int | None = 500) -> DataFrame:
    """Alerts (id, event, severity, headline, description, onset, expires, geometry) as typed events.

    The served description is cut to ``description_chars``; None keeps it whole.
    """
    described = F.coalesce("description", F.lit(""))
    text = F.concat(F.coalesce("event", F.lit("")), F.coalesce("headline", F.lit("")))
    kept = alerts.where(F.col("geometry").isNotNull() & (F.coalesce("event", F.lit("")) != ""))
    return kept.select(
        F.concat(F.lit("nws-"), F.col("id")).alias("source_event_id"),
        F.when(weather.mentions(text, weather.ALERT_WORDS), "winter_condition").otherwise("weather_alert").alias("event_type"),
        weather.alert_severity(F.col("severity")).cast("bigint").alias("severity"),
        F.col("onset").alias("starts_at"), F.col("expires").alias("ends_at"), "event", "headline",
        (described if description_chars is None else F.left(described, F.lit(description_chars))).alias("description"),
        "geometry")


def winter_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts whose event or headline names winter weather."""
    words = weather.ALERT_WATCH_WORDS
    return alerts.where(weather.mentions(F.col("event"), words) | weather.mentions(F.col("headline"), words))


def prediction_updates(rows: DataFrame) -> DataFrame:
    """Status per segment from closure probabilities (segment_id, closure_probability, updated_at)."""
    p = F.col("closure_probability")
    return rows.where(p.between(0, 1)).select(
        "segment_id", "closure_probability", probability_label(p).alias("label"),
        F.round((1 - p) * 100, 6).alias("score"), "updated_at")
