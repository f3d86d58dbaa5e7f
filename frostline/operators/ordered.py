"""Ordered statistics that no single task has to sort alone.

Ranks, percentiles and running totals need rows in order. A window over a key puts each key into one task, which
fails once a key holds a large part of the data. Here rows are first collapsed to one per distinct value, then
range-partitioned by (key, value), so that a large key spans many partitions; totals of earlier partitions are
added to the running totals inside each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.operators.lookup import lookup
from frostline.session import cut_lineage


def running_totals(df: DataFrame, keys: list[str], order: str, totals: list[str], descending: bool = False) -> DataFrame:
    """Add ``<t>_before`` (sum over earlier rows of the key) and ``<t>_total`` for each name in ``totals``.

    ``df`` has one row per (keys, order). It is stored once after range partitioning, so that both passes see the
    same partitions.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    # Without a fixed number, small range partitions are merged with their neighbours at run time; order is kept.
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], direction)
    stored = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "ordered")

    sums = stored.groupBy(*keys, "_part").agg(*[F.sum(t).alias(f"_s_{t}") for t in totals])
    # One row per key and partition it touches: at most (keys + partitions) rows.
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"),
        *[F.coalesce(F.sum(f"_s_{t}").over(earlier), F.lit(0)).alias(f"_o_{t}") for t in totals],
        *[F.sum(f"_s_{t}").over(whole).alias(f"{t}_total") for t in totals],
    )
    within = Window.partitionBy("_part", *keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.select("*", *[F.coalesce(F.sum(t).over(within), F.lit(0)).alias(f"_l_{t}") for t in totals])
    on = [local["_part"] == offsets["_k_part"]] + [local[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys]
    joined = local.join(offsets, on)
    for t in totals:
        joined = joined.withColumn(f"{t}_before", F.col(f"_l_{t}") + F.col(f"_o_{t}"))
    return joined.select(*df.columns, *[f"{t}_{s}" for t in totals for s in ("before", "total")])


def value_counts(df: DataFrame, keys: list[str], col: str, count: str = "n") -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias(count))


def exact_percentiles(df: DataFrame, keys: list[str], col: str, shares: dict[str, float],
                      counts: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key; ``shares`` maps output names to shares.

    ``counts`` names a column that already says how often each value occurs.
    """
    if counts is None:
        hist = value_counts(df, keys, col, "_n")
    else:
        hist = df.groupBy(*keys, col).agg(F.sum(counts).alias("_n"))
    run = running_totals(hist, keys, col, ["_n"])
    first, after = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    last_rank = F.col("_n_total") - 1

    def holds(rank):
        return (first <= rank) & (rank < after)

    picks, wanted = [], None
    for name, share in shares.items():
        position = last_rank * F.lit(float(share))
        low, high = F.floor(position), F.ceil(position)
        hit = holds(low) | holds(high)
        wanted = hit if wanted is None else wanted | hit
        picks += [
            F.max(F.when(holds(low), F.col(col))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col(col))).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_f_{name}"),
        ]
    agg = run.where(wanted).groupBy(*keys).agg(*picks)
    return agg.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in shares])


def bounded_percentiles(hist: DataFrame, keys: list[str], col: str, count: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of a histogram whose values are bounded in number, such as scores of six decimals."""
    values = F.array(*[F.lit(s) for s in shares.values()])
    agg = hist.groupBy(*keys).agg(F.percentile(F.col(col), values, F.col(count)).alias("_p"))
    return agg.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(shares)])


def average_ranks(df: DataFrame, keys: list[str], col: str, count: str) -> DataFrame:
    """Rank of each distinct value of a key, ties sharing their mean rank, centred on the middle rank."""
    hist = df.groupBy(*keys, col).agg(F.sum(count).alias("_n"))
    run = running_totals(hist, keys, col, ["_n"])
    centred = F.col("_n_before") + (F.col("_n") + 1) / 2 - (F.col("_n_total") + 1) / 2
    return run.select(*keys, col, centred.alias(f"{col}_rank"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Rank correlation per key, null where a side has no spread.

    Ranks go back to the cells by value. A value that many cells share, such as a score of 0, is looked up apart, so its
    cells do not meet in one task.
    """
    cells = cut_lineage(df.groupBy(*keys, x, y).agg(F.count("*").alias("_c")), "ranks")
    ranked = lookup(cells, average_ranks(cells, keys, x, "_c"), [*keys, x], "inner")
    ranked = lookup(cut_lineage(ranked, "ranks"), average_ranks(cells, keys, y, "_c"), [*keys, y], "inner")
    rx, ry, c = F.col(f"{x}_rank"), F.col(f"{y}_rank"), F.col("_c")
    sums = ranked.groupBy(*keys).agg(
        F.sum(c * rx * ry).alias("_xy"), F.sum(c * rx * rx).alias("_xx"), F.sum(c * ry * ry).alias("_yy"))
    return sums.select(*keys, F.when(
        (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias(name))
