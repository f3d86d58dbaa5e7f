"""Mixing data sources to target weights by temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.columns import given, quoted, words
from frostline.session import cut_lineage

BLOCKS = 4096
PARTS, ROUNDS = 32, 5
# Passes of the most repeated source to one of the least: up to about four, repeated text serves almost like new text.
MAX_REPEATS = 4.0
# How far the mixture goes from the entropy of the given shares (0) to that of equal ones (1).
EVENNESS = 0.5


def source_tokens(events: DataFrame, source: str = "data_source", description: str = "description") -> DataFrame:
    """(source, tokens): words of each source; null is a source of its own."""
    return events.groupBy(F.col(quoted(source)).alias("source")).agg(
        F.sum(F.size(words(given(description))).cast("long")).alias("tokens"))


def _mix_at(totals: DataFrame, exponents: list[float]) -> DataFrame:
    """Entropy (bits) and repetition of the weights share^exponent at each exponent, one row each."""
    df = totals.where("tokens > 0").select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("exponent"))
    # Powers are taken relative to the largest, which keeps them in range and cancels in the weights.
    x = F.col("exponent") * F.ln(F.col("tokens").cast("double"))
    rest = (F.col("exponent") - 1) * F.ln(F.col("tokens").cast("double"))
    top = df.groupBy("exponent").agg(F.max(x).alias("top"), F.max(rest).alias("most"), F.min(rest).alias("least"))
    df = df.join(top, "exponent")
    weight = F.exp(x - F.col("top"))
    return df.groupBy("exponent").agg(
        (F.ln(F.sum(weight)) - F.sum(weight * (x - F.col("top"))) / F.sum(weight)).alias("nats"),
        F.exp(F.first("most") - F.first("least")).alias("repeats")).select(
        "exponent", (F.col("nats") / F.ln(F.lit(2.0))).alias("entropy"), "repeats")


def temperature(totals: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1] nearest to 0 that keeps to the limit, or nearest to 1 that reaches the entropy.

    ``max_repeats`` bounds how often the most repeated source is passed when the least repeated one is passed once.
    Entropy falls and repetition falls as the exponent grows, so the interval is bisected; each Spark job tries
    ``PARTS`` inner points at once and ``ROUNDS`` of them leave 32^-5 of it. With both, the limit wins. Exponent 1 keeps
    the given shares and is returned for a table without tokens.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        found = {r["exponent"]: r for r in _mix_at(totals, points).collect()}
        if not found:
            return 1.0
        if max_repeats is not None:
            good = [p for p in points if found[p]["repeats"] <= max_repeats + 1e-9]
            if target_entropy is not None:
                enough = [p for p in good if found[p]["entropy"] >= target_entropy]
                best = max(enough) if enough else min(good, default=1.0)
                side = 1 if enough else -1
            else:
                best, side = min(good, default=1.0), -1
        else:
            enough = [p for p in points if found[p]["entropy"] >= (target_entropy or 0.0)]
            best, side = max(enough, default=0.0), 1
        step = (high - low) / PARTS
        low, high = (best, min(1.0, best + step)) if side > 0 else (max(0.0, best - step), best)
    return low if side > 0 else high


def between(totals: DataFrame, evenness: float) -> float | None:
    """The entropy at this part of the way from the given shares to equal ones; none for a table without tokens."""
    found = {r["exponent"]: r["entropy"] for r in _mix_at(totals, [0.0, 1.0]).collect()}
    return found[1.0] + evenness * (found[0.0] - found[1.0]) if found else None


def mixing_plan(events: DataFrame, exponent: float, budget_tokens: int | None = None, source: str = "data_source",
                description: str = "description") -> DataFrame:
    """(source, tokens, share, weight, repeats): how often each source is passed within the budget.

    Without a budget it is the smallest one that passes every source at least once. A source without tokens has weight 0
    and is passed once.
    """
    totals = source_tokens(events, source, description)
    return _plan(totals, exponent, budget_tokens)


def _plan(totals: DataFrame, exponent: float, budget_tokens: int | None) -> DataFrame:
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.ln(F.col("tokens").cast("double")))).otherwise(0.0)
    sums = totals.agg(F.sum("tokens").alias("all"), F.sum(power).alias("norm"), F.max(F.when(
        F.col("tokens") > 0, F.col("tokens") / power)).alias("least_budget")).head()
    every, norm, least = (float(sums[k] or 0) for k in ("all", "norm", "least_budget"))
    budget = float(budget_tokens) if budget_tokens is not None else least * norm
    weight = power / F.lit(norm or 1.0)
    return totals.select(
        "source", "tokens", (F.col("tokens") / F.lit(every or 1.0)).alias("share"), weight.alias("weight"),
        F.when(F.col("tokens") > 0, F.lit(budget) * weight / F.col("tokens")).otherwise(1.0).alias("repeats"))


def _rank_of(*parts) -> Column:
    return F.xxhash64(*parts)


def _fitting(blocks: Column, left: Column) -> Column:
    """For each block in turn, whether it has tokens that fit into what the blocks taken before have left."""
    def step(state, block):
        fits = (block["tokens"] > 0) & (block["tokens"] <= state["left"])
        return F.struct((state["left"] - F.when(fits, block["tokens"]).otherwise(0)).alias("left"),
                        F.concat(state["taken"], F.array(fits)).alias("taken"))

    start = F.struct(left.cast("double").alias("left"), F.array().cast("array<boolean>").alias("taken"))
    return F.aggregate(blocks, start, step, lambda state: state["taken"])


def mix_sources(events: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
                evenness: float | None = None, budget_tokens: int | None = None, event_id: str = "event_id", source: str = "data_source",
                description: str = "description", seed: int = 0) -> DataFrame:
    """Repeat events so that the words of each data source follow tempered weights.

    Source shares are raised to the exponent of ``temperature`` and normalised. ``evenness`` sets a
    target entropy at this part of the way from the entropy of the given shares to that of equal ones, so that the
    exponent follows the skew at hand; the limit on repeats wins over it. Rows are dealt to ``BLOCKS`` blocks a
    source by a hash of the id and text. A source is passed in epochs, each with its own permutation of the blocks:
    whole epochs first, then each block of the last permutation that fits into what is left of the source's budget; one
    that does not is skipped. So a source misses its budget by less than any block left out, and rows of a block stay
    together. Adds
    ``mix``: struct of epoch, block, weight, position, a number in (0, 1] by which sorting interleaves the sources in
    proportion, and the exponent with the entropy (bits) and repeats that its weights reach; a given column of that name is replaced. Null sources form a source; null texts have no words and follow
    their block. Repeated rows share a block and each is passed as often. An empty table gives an empty result.

    Only the id, source and word count reach the totals; a (source, block) table is joined back to the rows, spread over
    all blocks, so a source with most of the rows is spread over up to ``BLOCKS`` keys.
    """
    kept = [c for c in events.columns if c.lower() != "mix"]
    text, key = given(description), F.col(quoted(event_id)).cast("string")
    df = events.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), F.col(quoted(source)).alias("source"),
        F.pmod(_rank_of(key, text, F.lit(seed)), F.lit(BLOCKS)).cast("int").alias("block"),
        F.size(words(text)).cast("long").alias("tokens"))
    blocks = cut_lineage(df.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if target_entropy is None and evenness is not None:
        target_entropy = between(totals, evenness)
    exponent = temperature(totals, max_repeats, target_entropy)
    reached = _mix_at(totals, [exponent]).head()
    plan = _plan(totals, exponent, budget_tokens)
    plan = plan.select(F.col("source").alias("of"), F.col("tokens").alias("all_tokens"), "weight", "repeats",
                       F.floor(F.col("repeats") + 1e-9).cast("int").alias("whole"))
    dealt = blocks.join(plan, F.col("source").eqNullSafe(F.col("of")))
    # One array of at most BLOCKS blocks a source, in the order of its last permutation.
    dealt = dealt.groupBy("of", "weight", "repeats", "whole", "all_tokens").agg(F.array_sort(F.collect_list(F.struct(
        _rank_of("block", "whole", F.lit(seed)).alias("rank"), "block", "tokens"))).alias("blocks"))
    left = (F.col("repeats") - F.col("whole")) * F.col("all_tokens") + 1e-6
    dealt = dealt.withColumn("taken", _fitting(F.col("blocks"), left)).select(
        "of", "weight", "repeats", "whole", F.explode(F.arrays_zip("blocks", "taken")).alias("dealt"))
    dealt = dealt.select("of", F.col("dealt.blocks.block").alias("of_block"), "weight", "repeats", (
        F.col("whole") + F.col("dealt.taken").cast("int")).alias("passes"))
    df = df.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    df = df.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    at = F.pmod(_rank_of("block", "epoch", F.lit(seed)), F.lit(2 ** 31)) / F.lit(float(2 ** 31))
    df = df.withColumn("mix", F.struct(
        "epoch", "block", "weight",
        F.least((F.col("epoch") + at + 1e-9) / F.greatest("repeats", F.lit(1e-9)), F.lit(1.0)).alias("position"),
        F.lit(exponent).alias("exponent"), F.lit(reached["entropy"] if reached else None).cast("double").alias("entropy"),
        F.lit(reached["repeats"] if reached else None).cast("double").alias("repeats")))
    return df.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in kept], "mix")
