from collections import Counter

import pytest
from pyspark.sql import functions as F

from frostline.llm import columns, fingerprints, quality_rules
from tests.llm.samples import CLASHING, WORD, descriptions, events


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    often, covered, seen, again = Counter(grams), set(), set(), 0
    for at, gram in enumerate(grams):
        if often[gram] > 1:
            covered |= {at, at + 1, at + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    for line in lines:
        again += line in seen
        seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": again, "n_repeat_words": len(covered)}


def test_measures_equal_a_loop(spark):
    got = quality_rules.quality_rules(events(spark)).select("event_id", "description", "quality").collect()
    assert len(got) == len(descriptions())
    for r in got:
        want = measures(r["description"])
        assert {k: r["quality"][k] for k in want} == want
        assert r["quality"]["kept"] == (not r["quality"]["broken"])


def test_windows_with_one_hash_are_told_apart(spark):
    df = spark.createDataFrame([("a b c x a b c y b c d",), ("a b",), ("",)], ["t"]).select(
        columns.words(F.col("t")).alias("tokens"))
    exact = df.select(quality_rules._covered(quality_rules._starts_by_words(F.col("tokens"))).alias("n")).collect()
    assert [r["n"] for r in exact] == [6, 0, 0]
    assert [r["repeats"] for r in quality_rules.with_repeats(df).collect()] == [6, 0, 0]


def test_rules_judge_and_pass_whole_rows(spark):
    df = events(spark).withColumn("quality", F.lit("given"))
    kept = quality_rules.passed(df)
    assert kept.columns == df.columns and set(CLASHING) <= set(kept.columns)
    ids = {r["event_id"] for r in kept.select("event_id").collect()}
    assert {0, 1, 100, 200} <= ids and not ids & {300, 301, 302, 308, 309, 310}
    assert {r["quality"] for r in kept.select("quality").collect()} == {"given"}
    assert quality_rules.passed(df.where("false")).count() == 0
    plan = quality_rules.quality_rules(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_table_of_thresholds_decides(spark):
    df = events(spark, [(1, "one two three"), (2, "one")], clash=False)
    rules = [quality_rules.Rule("few", "n_words", None, 2, None)]
    got = {r["event_id"]: r["quality"]["broken"] for r in quality_rules.quality_rules(df, rules).collect()}
    assert got == {1: [], 2: ["few"]}


def test_winnowing_equals_a_loop(spark):
    df = events(spark)
    k, window = 3, 4
    got = fingerprints.winnow(df, k=k, window=window)
    assert got.columns == [*df.columns, "fingerprint"]
    tokens = df.select("description", columns.words(columns.given("description")).alias("w"))
    grams = {r["description"]: r["h"] for r in tokens.select("description", F.when(
        F.size("w") >= k, columns.hashed_grams(F.col("w"), k)).otherwise(F.when(F.size("w") > 0, F.array(F.xxhash64(
            F.array_join("w", "\n")))).otherwise(F.array().cast("array<bigint>"))).alias("h")).collect()}
    for r in got.select("description", "fingerprint").collect():
        h = [(x & (2 ** 64 - 1)) >> 33 for x in grams[r["description"]]]
        want = []
        for at in range(max(len(h) - window + 1, min(len(h), 1))):
            part = h[at:at + window]
            place = at + max(i for i, x in enumerate(part) if x == min(part))
            if (place, h[place]) not in want:
                want.append((place, h[place]))
        assert [(f["position"], f["hash"]) for f in r["fingerprint"]] == want


def test_a_shared_passage_is_found(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    df = events(spark, [(1, "salt on the road " + passage), (2, passage + " then nothing")], clash=False)
    prints = [{f["hash"] for f in r["fingerprint"]} for r in fingerprints.winnow(df).collect()]
    assert prints[0] & prints[1]


def test_edited_texts_follow_the_next_event(spark):
    rows = [(i, t) for i, t in descriptions() if i is not None and i != 303]
    got = {r["event_id"]: r for r in fingerprints.edited_fingerprints(events(spark, rows)).collect()}
    rows.sort(key=lambda r: r[0])
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        n = len(text) // 4
        assert got[i]["edited"] == text[:len(text) - n] + after[:n] and got[i]["n_chars"] == len(text)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["near_edited"] > got[0]["near_next"]


@pytest.mark.parametrize("rows", [[], [(None, "salt on the road")], [(5, "only one here")],
                                  [(5, "twice the same"), (5, "twice the same"), (6, "another text")]])
def test_few_rows_and_repeated_ids(spark, rows):
    got = fingerprints.edited_fingerprints(events(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["event_id"] is None:
            assert r["near_next"] == 0 and r["edited"] == "salt on the "
        if rows == [(5, "only one here")]:
            assert r["near_next"] == 1


def test_successors_over_many_ranges(spark):
    ids = spark.range(0, 999, 3).select(F.col("id").alias("event_id"))
    got = {r["event_id"]: r["next_id"] for r in fingerprints.successors(ids).collect()}
    assert got == {i: (i + 3 if i < 996 else 0) for i in range(0, 999, 3)}


def test_fingerprints_stay_in_the_engine(spark):
    plan = fingerprints.edited_fingerprints(events(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
