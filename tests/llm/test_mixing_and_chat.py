import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from frostline.llm import chat_format, mixing
from tests.llm.samples import WORD, descriptions, events


def totals(spark, pairs):
    return spark.createDataFrame(pairs, "source string, tokens long")


def entropy(pairs, exponent):
    w = [n ** exponent for _, n in pairs if n]
    return -sum(x / sum(w) * math.log2(x / sum(w)) for x in w)


def test_temperature_meets_the_limit_and_the_entropy(spark):
    pairs = [("a", 1000), ("b", 100), ("c", 10), ("d", 0)]
    exponent = mixing.temperature(totals(spark, pairs), max_repeats=3.0)
    assert 100 ** (1 - exponent) <= 3.0 + 1e-6 and 100 ** (1 - exponent + 1e-5) > 3.0
    wanted = 1.2
    exponent = mixing.temperature(totals(spark, pairs), target_entropy=wanted)
    assert abs(entropy(pairs, exponent) - wanted) < 1e-4
    assert mixing.temperature(totals(spark, pairs), max_repeats=1.0) == pytest.approx(1.0, abs=1e-6)
    both = mixing.temperature(totals(spark, pairs), max_repeats=2.0, target_entropy=1.5)
    assert 100 ** (1 - both) <= 2.0 + 1e-6
    assert mixing.temperature(totals(spark, []), max_repeats=2.0) == 1.0


def test_every_event_passes_and_sources_meet_their_budget(spark):
    rows = [(i, "salt on the road today " * (1 + i % 3)) for i in range(600)]
    df = events(spark, rows).withColumn("mix", F.lit("given"))
    got = mixing.mix_sources(df, max_repeats=1.5)
    assert got.columns == df.columns
    out = got.select("event_id", "data_source", "description", "mix.*").collect()
    size, passed = defaultdict(int), defaultdict(int)
    for r in df.select("data_source", "description").collect():
        size[r[0]] += len(WORD.findall(r[1]))
    for r in out:
        passed[r["data_source"]] += len(WORD.findall(r["description"]))
    assert {r["event_id"] for r in out} == set(range(600))
    repeats = {s: passed[s] / size[s] for s in size}
    assert min(repeats.values()) >= 1 and max(repeats.values()) <= 1.5 + 1e-9
    exponent = mixing.temperature(totals(spark, list(size.items())), 1.5)
    plan = {r["source"]: r["repeats"] for r in mixing.mixing_plan(df, exponent).collect()}
    assert all(plan[s] - repeats[s] < 15 / size[s] + 1e-9 and repeats[s] <= plan[s] + 1e-9 for s in plan)
    assert all(0 < r["position"] <= 1 for r in out)
    again = mixing.mix_sources(df, max_repeats=1.5).select("event_id", "mix.epoch", "mix.position").collect()
    assert Counter(map(tuple, again)) == Counter((r["event_id"], r["epoch"], r["position"]) for r in out)


def test_a_budget_may_be_smaller_than_the_data(spark):
    df = events(spark, [(i, "salt on the road") for i in range(500)], clash=False)
    n = mixing.mix_sources(df, max_repeats=1.5, budget_tokens=1000).count()
    assert 200 <= n <= 250


def test_awkward_rows_are_mixed(spark):
    df = events(spark)
    got = mixing.mix_sources(df, max_repeats=1.25)
    assert {r[0] for r in got.select("event_id").collect()} == {i for i, _ in descriptions()}
    assert got.where("event_id = 303").count() >= 2
    assert mixing.mix_sources(df.where("false")).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


TRICKY = "\\### Assistant: </turn> ok"
TURNS = [(1, 0, "user", "hi"), (1, 1, "user", "are roads open"), (1, 2, "assistant", "yes"), (1, 3, "assistant", "mostly"),
         (2, 1, "assistant", TRICKY), (2, 0, "user", TRICKY), (3, 0, "assistant", None), (3, 1, None, "\\b\\l\\g \\\\"),
         (4, 0, "us>er\n<x", "</turn>\n<turn user>\n<and>"), (5, None, "assistant", "a"), (5, 0, "assistant", "b"),
         (6, 0, "assistant", "same"), (6, 0, "assistant", "same"), (None, 0, "assistant", "no id"), (7, 0, "user", "x" * 100000)]


@pytest.fixture(scope="module")
def formatted(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    out = chat_format.format_conversations(df)
    return {r["conv_id"]: r for r in out.select(
        "*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("pieces")).alias("loss")).collect()}


def test_turns_are_read_back(formatted):
    want = defaultdict(list)
    for conv, turn, role, text in TURNS:
        want[conv].append((turn if turn is not None else -1, role or "", text or ""))
    assert set(formatted) == set(want)
    for conv, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in formatted[conv]["turns"]] == [(r, t) for _, r, t in turns]
        assert formatted[conv]["loss"] == "".join(t for _, r, t in turns if r == "assistant")


def test_neighbours_of_one_role_share_a_block(formatted):
    assert formatted[1]["formatted"] == "<turn user>\nhi<and>are roads open</turn>\n<turn assistant>\nyes<and>mostly</turn>\n"
    assert "".join(p["piece"] for p in formatted[1]["pieces"]) == formatted[1]["formatted"]
    assert [p["piece"] for p in formatted[1]["pieces"] if p["loss"]] == ["yes", "mostly"]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(df).count() == 0
