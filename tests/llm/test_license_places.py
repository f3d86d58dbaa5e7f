from frostline.llm import license_scan
from tests.llm.samples import events

PHRASES = {label: phrase for phrase, label in license_scan.FURTHER}
MIT, GPL = PHRASES["mit-text"], PHRASES["gpl-text"]


def doubled(phrase, n):
    """n words of a notice, all of them between foreign words, so that no two follow one another."""
    return " road ".join(phrase.split()[:n])


def scattered(phrase):
    """Every word pair of a notice in its order, with foreign words between the pairs."""
    words = phrase.split()
    return " road closed ".join(f"{a} {b}" for a, b in zip(words, words[1:]))


def test_repeated_and_scattered_words_are_no_notice(spark):
    half = " ".join(MIT.split()[:8])
    rows = [(1, "of this software " * 8), (2, "free software " * 20), (3, scattered(MIT)), (4, doubled(GPL, 20)),
            (5, half), (5, half), (5, half), (6, " ".join(reversed(MIT.split())) + " of this software" * 9)]
    got = license_scan.scan_licenses(events(spark, rows, clash=False), "event_id", "description").collect()
    assert len(got) == len(rows) and {(r["labels"], r["score"]) for r in got} == {("", 0.0)}


def test_true_notices_stand_among_repeats(spark):
    words = MIT.split()
    rows = [(1, "of this software " * 8 + MIT), (2, MIT + " of this software" * 8), (3, " ".join([MIT] * 3)),
            (4, " ".join([*words[:4], "now", "and", "here", *words[4:]])), (5, " ".join([*words[:9], *words[11:]])),
            (6, MIT), (6, MIT)]
    got = license_scan.scan_licenses(events(spark, rows, clash=False), "event_id", "description").collect()
    n = len(words) - 1
    assert sorted((r["release_id"], r["labels"], round(r["score"] * n)) for r in got) == [
        (1, "mit-text", n), (2, "mit-text", n), (3, "mit-text", n), (4, "mit-text", n - 1), (5, "mit-text", n - 3),
        (6, "mit-text", n), (6, "mit-text", n)]


def test_a_place_starts_with_its_chain(spark):
    df = events(spark, [(1, "of this software road " * 2 + MIT)], clash=False)
    df = df.select("event_id", license_scan.notice_words(df["description"]).alias("tokens"))
    got = license_scan.license_hits(df, ["event_id"], "tokens").collect()
    assert [(r["label"], r["start"], r["share"]) for r in got] == [("mit-text", 8, 1.0)]
