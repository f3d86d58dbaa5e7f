"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Wide rows of a task; a table is few bytes where many rows are alike, so bytes do not tell how much work they are.
ROWS_A_TASK = 200_000
_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(app: str = "frostline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path would be
    lost with its executor, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="frostline-")
    return _LOCAL_FALLBACK[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/frostline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A written table survives lost executors and gives the optimizer true sizes, so joins on it may be
    broadcast on evidence instead of on a hint.
    """
    return _written(df, new_path(df.sparkSession, label), **options)


def tasks_for(spark: SparkSession, rows: int, most_rows: int) -> int:
    """Tasks for ``rows`` rows: ``ROWS_A_TASK`` each while a shuffle has so many partitions, and at most ``most_rows`` beyond."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-rows // ROWS_A_TASK), max(usual, -(-rows // most_rows))))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` by key to tasks for as many ``rows`` as it has, or will have once it is unfolded."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *keys)


def _written(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a stored stage that is no longer read."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


class RoundTables:
    """Tables of an iterative job: each round is written once, and rounds no longer read are removed."""

    def __init__(self, spark: SparkSession, label: str, keep: int = 2):
        self._spark, self._label, self._keep = spark, label, keep
        self._paths: list[str] = []

    def store(self, df: DataFrame) -> DataFrame:
        path = new_path(self._spark, self._label)
        table = _written(df, path)
        self._paths.append(path)
        while len(self._paths) > self._keep:
            remove_path(self._spark, self._paths.pop(0))
        return table

    def clear(self) -> None:
        """Remove all rounds, once nothing reads them."""
        while self._paths:
            remove_path(self._spark, self._paths.pop())
