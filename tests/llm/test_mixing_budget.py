from collections import Counter

from pyspark.sql import functions as F

from frostline.llm import mixing


def mixed(spark, rows, **settings):
    df = spark.createDataFrame(rows, "event_id long, data_source string, description string")
    return df, mixing.mix_sources(df, **settings)


def test_a_block_that_does_not_fit_is_skipped(spark):
    rows = [(i, "a", "salt " * 40) for i in range(60)] + [(1000 + i, "b", "salt " * (600 if i < 3 else 3)) for i in range(40)]
    for seed in range(4):
        df, got = mixed(spark, rows, max_repeats=1.1, seed=seed)
        passes = Counter(r[0] for r in got.select("event_id").collect())
        sizes = {i: len(t.split()) for i, s, t in rows if s == "b"}
        exponent = mixing.temperature(mixing.source_tokens(df), 1.1)
        plan = {r["source"]: r["repeats"] for r in mixing.mixing_plan(df, exponent).collect()}
        left = plan["b"] * sum(sizes.values()) - sum(passes[i] * n for i, n in sizes.items())
        assert all(passes[i] >= 1 for i in sizes) and left >= -1e-6
        assert left < min(n for i, n in sizes.items() if passes[i] == 1)


def test_tempering_moves_skewed_sources(spark):
    rows = [(i, "hot", "salt on the road today") for i in range(3000)] + [(9000 + i, "small", "ice on a bridge") for i in range(38)]
    df, got = mixed(spark, rows)
    share = got.where("data_source = 'small'").count() / 38
    weights = {r[0]: r[1] for r in got.select("data_source", "mix.weight").distinct().collect()}
    assert 3.9 <= share <= 4.0
    assert 3.9 <= weights["small"] / weights["hot"] / (38 * 4 / (3000 * 5)) <= 4.0 + 1e-6
    assert got.where(F.col("data_source") == "hot").select("event_id").distinct().count() == 3000
