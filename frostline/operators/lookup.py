"""Equi-joins of rows to a table with one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is looked up apart if it holds more than this share of the rows, and at least so many. So there are at most
# HOT_KEYS such keys at any size of the data.
HOT_KEYS = 1000
HOT_ROWS = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, which has at most one row per key; ``how`` is ``left`` or ``inner``.

    A shuffle by key would put all rows of one key into one task. Keys that hold more than a ``HOT_KEYS``-th of the rows
    are found first, by a count that is reduced before its shuffle. Their rows of ``table`` are at most ``HOT_KEYS``, so
    they are copied to all tasks and the rows of these keys stay where they are; all other rows are joined by shuffle.
    Null keys match nothing. The rows are read twice; they should be stored.
    """
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).head()
    limit = max(HOT_ROWS, (whole["n"] or 0) // HOT_KEYS)
    if (whole["most"] or 0) <= limit:
        return rows.join(table, keys, how)
    found = [f for f in table.columns if f not in keys]
    hot = counts.where(F.col("_n") > limit).select(*keys).join(table.withColumn("_there", F.lit(True)), keys, "left").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*found, "_there").alias("_found"))
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    marked = rows.join(F.broadcast(hot), same, "left")
    columns = [c for c in rows.columns if c not in keys]
    near = marked.where(F.col("_found").isNotNull())
    if how == "inner":
        near = near.where(F.col("_found._there"))
    near = near.select(*keys, *columns, *[F.col("_found")[f].alias(f) for f in found])
    far = marked.where(F.col("_found").isNull()).select(*rows.columns).join(table, keys, how)
    return near.unionByName(far)
