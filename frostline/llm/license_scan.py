"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.columns import ascii_lower, given, quoted

K = 2
SLACK, SHARE, LONG = 3, 0.8, 8

# Phrases that always count as they stand, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Further notices. Those of LONG or more words may hold inserted, missing or changed words.
FURTHER = (
    ("all rights reserved", "all-rights-reserved"),
    ("cc by nc", "cc-by-nc"), ("cc by sa", "cc-by-sa"), ("cc by nd", "cc-by-nd"), ("cc0 1 0", "cc0"),
    ("creative commons attribution", "creative-commons"), ("public domain dedication", "public-domain"),
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("gnu general public license version 3", "gpl-3"), ("gnu general public license version 2", "gpl-2"),
    ("apache license version 2 0", "apache-2.0"), ("mozilla public license", "mpl"), ("eclipse public license", "epl"),
    ("bsd license", "bsd"), ("open database license", "odbl"), ("open government licence", "ogl"),
    ("spdx license identifier", "spdx"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd-text"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
     "an as is basis without warranties or conditions of any kind", "apache-text"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation", "gpl-text"),
)


def notice_words(text: Column) -> Column:
    """Lower-case words: runs of digits, letters a-z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, base, n_grams, at, first, second, hash): every k-gram position of the templates, a fixed table."""
    rows = []
    for number, (phrase, label) in enumerate([*BASE, *FURTHER]):
        tokens = phrase.split()
        for at in range(len(tokens) - K + 1):
            rows.append((number, label, number < len(BASE), len(tokens) - K + 1, at, *tokens[at:at + K]))
    df = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, at int, first string, second string")
    return df.withColumn("hash", F.xxhash64("first", "second"))


def license_hits(texts: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """Verified places of templates: the keys, label, base, start, share.

    All rolling k-gram hashes are joined to the template positions; equal hashes of unequal words are dropped in the join.
    A hit votes for its diagonal, the text position minus the template position. In long templates neighbouring
    diagonals whose positions are no more than ``SLACK`` apart are merged, which bridges inserted and missing words. The
    span of merged diagonals is then verified: from each hit, the longest chain in which text and template positions both
    rise is sought, no longer than the template and ``SLACK`` words for each k-gram that may be missing. So a k-gram of the
    text counts once, as does one of the template, and repeated or scattered words add nothing. A place stands if its best
    chain holds every k-gram of a short template, or ``SHARE`` of a long one's; it starts where the chain does. Rows that
    agree in the keys count once.
    """
    words = F.col(tokens)
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (K - 1), F.lit(0))), lambda w, i: F.struct(
        F.xxhash64(w, F.get(words, i + 1)).alias("hash"), w.alias("a"), F.get(words, i + 1).alias("b")))
    rolled = texts.select(*keys, F.posexplode(grams).alias("position", "gram")).select(
        *keys, "position", F.col("gram.hash").alias("gram_hash"), "gram.a", "gram.b")
    # The template table is fixed and a few kilobytes, whatever the texts.
    found = rolled.join(F.broadcast(template_grams(texts.sparkSession)), (F.col("gram_hash") == F.col("hash")) & (
        F.col("a") == F.col("first")) & (F.col("b") == F.col("second")))
    found = found.withColumn("diagonal", F.col("position") - F.col("at"))
    template = ["template", "label", "base", "n_grams"]
    lines = found.groupBy(*keys, *template, "diagonal").agg(F.collect_set("at").alias("ats"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    is_long = F.col("n_grams") >= LONG - K + 1
    lines = lines.withColumn("opens", F.when(F.coalesce(is_long & (apart <= SLACK), F.lit(False)), 0).otherwise(1))
    lines = lines.withColumn("place", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "template", "place")
    # No chain is longer than the hits of its place, which leaves few places to be verified.
    needed = F.when(is_long, F.ceil(F.col("n_grams") * SHARE - 1e-9)).otherwise(F.col("n_grams")).cast("int")
    lines = lines.withColumn("needed", needed).withColumn("hits", F.sum(F.size("ats")).over(within))
    hits = lines.where("hits >= needed").select(*keys, *template, "place", "needed", "diagonal", F.explode("ats").alias("at"))
    hits = hits.withColumn("position", F.col("diagonal") + F.col("at"))
    furthest = max(_reach(len(phrase.split()) - K + 1) for phrase, _ in [*BASE, *FURTHER])
    ahead = within.orderBy("position").rangeBetween(0, furthest)
    hits = hits.withColumn("ahead", F.collect_list(F.struct("position", "at")).over(ahead))
    reach = F.col("n_grams") - 1 + SLACK * (F.col("n_grams") - F.col("needed"))
    hits = hits.withColumn("ahead", F.array_sort(F.filter("ahead", lambda h: (
        h["position"] > F.col("position")) & (h["position"] <= F.col("position") + reach) & (h["at"] > F.col("at")))))
    hits = hits.where(F.size("ahead") + 1 >= F.col("needed")).withColumn("votes", _longest_chain())
    places = hits.where("votes >= needed").groupBy(*keys, *template, "place").agg(
        F.max(F.struct("votes", (-F.col("position")).alias("back"))).alias("best"))
    return places.select(*keys, "label", "base", (-F.col("best.back")).cast("long").alias("start"),
                         (F.col("best.votes") / F.col("n_grams")).alias("share"))


def _reach(n_grams: int) -> int:
    """Text positions from the first k-gram of a chain to its last, at most."""
    return n_grams - 1 + SLACK * int(n_grams * (1 - SHARE) + 1e-9)


def _longest_chain() -> Column:
    """Hits in the longest chain that starts at (``position``, ``at``) and goes on in ``ahead``, sorted by position."""
    def link(position, at, votes):
        return F.struct(position.alias("position"), at.alias("at"), votes.alias("votes"))

    def longer(chains, hit):
        before = F.filter(chains, lambda c: (c["position"] < hit["position"]) & (c["at"] < hit["at"]))
        return F.concat(chains, F.array(link(
            hit["position"], hit["at"], F.array_max(F.transform(before, lambda c: c["votes"])) + 1)))

    first = F.array(link(F.col("position"), F.col("at"), F.lit(1)))
    return F.aggregate("ahead", first, longer, lambda chains: F.array_max(F.transform(chains, lambda c: c["votes"])))


def scan_licenses(releases: DataFrame, release_id: str = "url", text: str = "text") -> DataFrame:
    """License notices in the texts of press releases.

    Result, a row per release: release_id, n_words, n_base (places of the base phrases), first_word and last_word (their
    smallest and largest start, null without one), base_labels and labels (distinct, sorted, comma-joined; ``labels`` has
    those of further notices too) and score, the largest share of a template found (0 without any). Null texts count as
    empty. A null id is an id. Rows that agree in id and text each give a row of their own; other columns are left out;
    an empty table gives an empty result. Only k-grams that stand in a template leave their task, so a text with a
    frequent word pair costs no more than its length.
    """
    base = releases.select(F.col(quoted(release_id)).alias("release_id"), given(text).alias("body"))
    base = base.withColumn("digest", F.xxhash64("body")).withColumn("tokens", notice_words(F.col("body")))
    hits = license_hits(base, ["release_id", "digest"], "tokens")
    marked = F.when(F.col("base"), F.col("start"))

    def listed(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    hits = hits.groupBy(F.col("release_id").alias("of"), F.col("digest").alias("of_digest")).agg(
        F.count(marked).alias("n_base"), F.min(marked).alias("first_word"), F.max(marked).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"),
        F.max("share").alias("score"))
    sizes = base.select("release_id", "digest", F.size("tokens").cast("long").alias("n_words"))
    df = sizes.join(hits, F.col("release_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    return df.select(
        "release_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
