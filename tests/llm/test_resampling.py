import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from frostline.llm import resampling as rs
from tests.llm.samples import descriptions, events, low

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RELEASES = ["PennDOT closed the ramp on Penn and Liberty due to snow.", "", None, "Crews plow and salt the lane near Butler; expect ice",
            "été Été ÉTÉ", "salt " * 50]


def grams(text, min_n, max_n):
    words = WORD.findall(low(text))
    return len(words), [" ".join(words[i:i + n]) for n in range(min_n, max_n + 1) for i in range(len(words) - n + 1)]


def by_hand(rows, releases, min_n=1, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def bucket(gram):
        return crc32(gram.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text, min_n, max_n)[1]))
    for text in releases:
        t.update(map(bucket, grams(text, min_n, max_n)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for event_id, text in rows:
        n_words, found = grams(text, min_n, max_n)
        gains = [math.floor(1000 * math.log((t[bucket(g)] + 1) * (all_s + buckets) / ((s[bucket(g)] + 1) * (all_t + buckets))))
                 for g in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if event_id is None else event_id}".encode()).hexdigest()[:8], 16)
        out.append((event_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return sorted([(r[0], r[2], r[3], r[4]) for r in out], key=str), [(r[0], r[3], r[4]) for r in drawn]


def drawn(df):
    return [(r["event_id"], r["weight"], r["score"]) for r in df.where("rank is not null").orderBy("rank").collect()]


@pytest.fixture(scope="module")
def releases(spark):
    return spark.createDataFrame([(t, None) for t in RELEASES], "text string, `n_words` int")


@pytest.mark.parametrize("settings", [{}, {"max_n": 2}, {"min_n": 2, "max_n": 3, "buckets": 70_000, "percent": 50},
                                      {"buckets": 3, "min_words": 0, "percent": 100, "seed": 7}])
def test_descriptions_as_by_hand(spark, releases, settings):
    rows = descriptions() + [(800 + i, "Penn ramp closed due to snow. " * (i + 3)) for i in range(30)]
    got = rs.resample_events(events(spark, rows), releases, **settings)
    every, chosen = by_hand(rows, RELEASES, **settings)
    assert got.columns == ["event_id", "n_features", "weight", "score", "rank"]
    assert sorted([(r["event_id"], r["n_features"], r["weight"], r["score"]) for r in got.collect()], key=str) == every
    assert drawn(got) == chosen and chosen
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, len(chosen) + 1))


def test_runs_are_found_from_their_spans():
    text = "Snow-covered  ROAD\x7fat\tÉcole 28_north"
    for n in (1, 2, 3, 7):
        want = [crc32(g.encode()) % 977 for g in grams(text, n, n)[1]]
        assert rs.gram_buckets(text, [rs.gram_pattern(n)], 977) == want
    assert rs.gram_buckets(" \n", [rs.gram_pattern(1)]) == [] == rs.gram_buckets("one two", [rs.gram_pattern(3)])


def test_ties_go_to_the_smaller_id(spark, releases):
    """Repeated rows share their score, in many range partitions; all get ranks of their own."""
    rows = [(i % 7, "plow the ramp on Penn now " * 5) for i in range(700)]
    got = rs.resample_events(events(spark, rows, clash=False).repartition(5), releases, percent=50)
    _, chosen = by_hand(rows, RELEASES, percent=50)
    assert drawn(got) == chosen and len(chosen) == 350


def test_empty_sides(spark, releases):
    df = events(spark, descriptions())
    assert rs.resample_events(df.where("false"), releases).count() == 0
    none = rs.resample_events(df, releases.where("false"))
    assert drawn(none) == by_hand(descriptions(), [])[1]
    short = rs.resample_events(df.where("event_id between 300 and 306"), releases)
    assert short.count() == 8 and short.where("rank is not null").count() == 0


def test_events_like_the_releases_are_drawn_more_often(spark):
    near = [(i, "the department restricted traffic on the parkway for repairs of the bridge deck over the river this week again now") for i in range(100)]
    far = [(1000 + i, "abc def ghi jkl mno pqr stu vwx yza bcd efg hij klm nop qrs tuv wxy zab cde fgh") for i in range(900)]
    target = spark.createDataFrame([(near[0][1],)] * 50, "text string")
    got = rs.resample_events(events(spark, near + far, clash=False), target)
    assert got.where("rank is not null and event_id < 1000").count() > 90
    assert got.select(F.min("weight")).first()[0] < 0
