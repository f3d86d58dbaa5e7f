"""The whole mixture against a loop over blocks, at an exponent found by bisection in Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from frostline.llm import mixing
from tests.llm.samples import sentence


def entropy(sizes, exponent):
    w = [n ** exponent for n in sizes.values() if n]
    return -sum(x / sum(w) * math.log2(x / sum(w)) for x in w)


def bisected(sizes, target):
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(sizes, mid) >= target else (low, mid)
    return low


def by_hand(rows, ranks, exponent, seed=0):
    """Passes of each row: ``rows`` are (event_id, source, words, block), ``ranks`` the order of blocks by epoch."""
    sizes, blocks = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for _, source, words, block in rows:
        sizes[source] += words
        blocks[source][block] += words
    budget = max(n / n ** exponent for n in sizes.values() if n) * sum(n ** exponent for n in sizes.values() if n)
    norm = sum(n ** exponent for n in sizes.values() if n)
    passes = {}
    for source, n in sizes.items():
        repeats = budget * n ** exponent / norm / n if n else 1.0
        whole = math.floor(repeats + 1e-9)
        left = (repeats - whole) * n + 1e-6
        for block in sorted(blocks[source], key=lambda b: (ranks[b, whole], b, blocks[source][b])):
            more = 0 < blocks[source][block] <= left
            left -= blocks[source][block] if more else 0
            passes[source, block] = whole + more
    return Counter({row: passes[row[1], row[3]] for row in rows})


@pytest.mark.parametrize("evenness, repeats", [(0.5, 4.0), (0.25, None), (0.75, 100.0)])
def test_mixture_equals_a_loop(spark, evenness, repeats):
    r = random.Random(5)
    rows = [(i, source, sentence(r, r.randint(1, 40))) for i, source in enumerate(["a"] * 700 + ["b"] * 90 + ["c"] * 25 + [None] * 4)]
    df = spark.createDataFrame(rows, "event_id long, data_source string, description string")
    blocks = df.select("event_id", F.pmod(F.xxhash64(F.col("event_id").cast("string"), "description", F.lit(0)), F.lit(mixing.BLOCKS))
                       .cast("int").alias("block")).collect()
    block = {row["event_id"]: row["block"] for row in blocks}
    flat = [(i, s, len(t.split()), block[i]) for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in flat:
        sizes[s] += n
    target = entropy(sizes, 1.0) + evenness * (entropy(sizes, 0.0) - entropy(sizes, 1.0))
    exponent = bisected(sizes, target)
    if repeats is not None:
        # The limit wins: the smallest exponent that keeps to it.
        exponent = max(exponent, 1 - math.log(repeats) / math.log(max(sizes.values()) / min(sizes.values())))
    got = mixing.mix_sources(df, max_repeats=repeats, evenness=evenness)
    told = got.select("mix.exponent", "mix.entropy", "mix.repeats").distinct().collect()
    assert len(told) == 1 and told[0]["exponent"] == pytest.approx(exponent, abs=1e-5)
    assert told[0]["entropy"] == pytest.approx(entropy(sizes, exponent), abs=1e-3) and 0 < told[0]["exponent"] < 1
    wanted = sorted({e for e in (1, 2, 3)} | {row["epoch"] + 1 for row in got.select("mix.epoch").distinct().collect()})
    order = spark.createDataFrame([(b, e) for b in set(block.values()) for e in wanted], "block int, whole int").select(
        "block", "whole", F.xxhash64("block", "whole", F.lit(0)).alias("rank")).collect()
    ranks = defaultdict(int, {(row["block"], row["whole"]): row["rank"] for row in order})
    want = by_hand(flat, ranks, told[0]["exponent"])
    passed = Counter(row["event_id"] for row in got.collect())
    assert {row[0]: n for row, n in want.items()} == dict(passed)


def test_query_mixes_at_an_inner_exponent(spark):
    from frostline.llm.queries import QUERIES

    got = QUERIES["op7_mix_sources"](spark, "/root/testdata/sf0.001").select("exponent").distinct().collect()
    assert len(got) == 1 and 0 < got[0]["exponent"] < 1
