"""Quality rules: a table of thresholds on ratios of a text, compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.columns import given, hashed_grams, quoted, total, unpacked, whole_row, words

WINDOW = 3
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "at", "from", "this",
    "be", "are", "or", "an", "a", "not", "have",
    "le", "la", "les", "de", "du", "des", "et", "un", "une", "est", "que", "pour", "dans", "par", "sur", "au", "en",
    "der", "die", "das", "und", "den", "dem", "zu", "von", "mit", "ist", "ein", "eine", "im", "auf", "nicht", "als",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "su", "lo", "al", "no",
]


class Rule(NamedTuple):
    """A text breaks the rule if ``measure / per`` lies outside [low, high]; texts under ``from_words`` are not tried."""

    name: str
    measure: str
    per: str | None
    low: float | None
    high: float | None
    from_words: int = 1


#: The threshold table. ``per`` None compares the measure itself.
RULES = (
    Rule("length", "n_words", None, 1, None, 0),
    Rule("word_length", "word_chars", "n_words", 1.5, 24, 5),
    Rule("symbols", "n_symbols", "n_words", None, 0.2, 5),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None, 40),
    Rule("bare_words", "n_bare_words", "n_words", None, 0.25, 5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.4, 12),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5, 5),
)
#: The table of a filter before the classifier, which judges texts where one repeated short line alone would decide.
FILTER_RULES = tuple(r._replace(from_words=50) if r.name == "repeated_words" else r for r in RULES)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
            "n_bare_words")


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the given ascending positions."""
    return total(F.transform(starts, lambda p, i: F.least(
        F.lit(WINDOW).cast("long"), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW).cast("long")))))


def _same_window(tokens: Column, a: Column, b: Column) -> Column:
    same = F.lit(True)
    for j in range(WINDOW):
        same = same & (F.get(tokens, (a + j).cast("int")) == F.get(tokens, (b + j).cast("int")))
    return same


def _starts_by_hash(order: Column, n: Column) -> Column:
    """Positions whose neighbour in ``order`` has the same hash. An entry is a multiple of ``n`` plus a position."""
    def twin(v, other):
        return F.coalesce(v - F.pmod(v, n) == other - F.pmod(other, n), F.lit(False))

    found = F.filter(order, lambda v, i: twin(v, F.get(order, i - 1)) | twin(v, F.get(order, i + 1)))
    return F.sort_array(F.transform(found, lambda v: F.pmod(v, n)))


def _starts_by_words(tokens: Column) -> Column:
    """The same positions by sorting the windows themselves."""
    n = F.size(tokens)
    windows = F.sort_array(F.transform(F.slice(tokens, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.struct(
        w.alias("a"), F.get(tokens, i + 1).alias("b"), F.get(tokens, i + 2).alias("c"), i.cast("long").alias("at"))))

    def twin(v, other):
        return F.coalesce((v["a"] == other["a"]) & (v["b"] == other["b"]) & (v["c"] == other["c"]), F.lit(False))

    found = F.filter(windows, lambda v, i: twin(v, F.get(windows, i - 1)) | twin(v, F.get(windows, i + 1)))
    return F.sort_array(F.transform(found, lambda v: v["at"]))


def with_repeats(df: DataFrame) -> DataFrame:
    """Add ``repeats``, the words in windows found twice or more, from ``tokens``.

    Window hashes find the texts that may have any. In those, hash and position are sorted as one number; should two
    different windows share a number's hash part, the windows themselves are sorted instead, so that the count is exact.
    """
    n = F.size("tokens").cast("long")
    df = df.withColumn("grams", hashed_grams(F.col("tokens"), WINDOW))
    df = df.withColumn("order", F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.sort_array(F.transform("grams", lambda h, i: F.shiftright(h, 2) - F.pmod(F.shiftright(h, 2), n) + i))))
    order = F.col("order")
    clash = F.exists(F.transform(order, lambda v, i: F.coalesce(
        (v - F.pmod(v, n) == F.get(order, i + 1) - F.pmod(F.get(order, i + 1), n))
        & ~_same_window(F.col("tokens"), F.pmod(v, n), F.pmod(F.get(order, i + 1), n)), F.lit(False))), lambda c: c)
    df = df.withColumn("starts", F.when(order.isNull(), F.array().cast("array<bigint>")).when(
        clash, _starts_by_words(F.col("tokens"))).otherwise(_starts_by_hash(order, n)))
    return df.withColumn("repeats", _covered(F.col("starts")))


def verdict(rules: Sequence[Rule], measure) -> Column:
    """Names of the broken rules; ``measure`` gives the column of a measure."""
    broken = []
    for r in rules:
        value = measure(r.measure).cast("double")
        if r.per:
            value = value / F.greatest(measure(r.per), F.lit(1)).cast("double")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (value > F.lit(float(r.high)))
        broken.append(F.when(bad & (measure("n_words") >= r.from_words), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(events: DataFrame, rules: Sequence[Rule] = RULES, description: str = "description") -> DataFrame:
    """Measure the description of every traffic event and try the threshold table on it.

    Adds ``quality``, a struct of the measures (long), ``broken`` (names of broken rules) and ``kept`` (none is broken);
    a given column of that name is replaced, all others stay. Words are runs without ASCII white space. ``n_lines`` are
    the lines with a word, ``n_dup_lines`` those equal to an earlier one, ``n_repeat_words`` the words in three-word
    windows found twice or more in the text, ``n_bare_words`` the words without letter or digit. A null description
    counts as empty and breaks ``length``. Repeated rows are judged alike, each on its own; an empty table gives an
    empty result. Every row is judged within its own task: nothing is shuffled, and no user function is called.
    """
    df = events.select(whole_row(events), given(description).alias("text"))
    df = with_repeats(df.withColumn("tokens", words(F.col("text"))))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    tokens = F.col("tokens")
    joined = F.array_join(tokens, "")
    measures = {
        "n_words": F.size(tokens), "word_chars": F.length(joined),
        "n_symbols": F.length(joined) - F.length(F.translate(joined, SYMBOLS, "")),
        "n_lines": F.size("lines"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.col("repeats"),
        "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_bare_words": F.size(F.filter(tokens, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))),
    }
    df = df.select("row", *[measures[m].cast("long").alias(m) for m in MEASURES])
    df = df.withColumn("broken", verdict(rules, F.col))
    judged = F.struct(*MEASURES, "broken", (F.size("broken") == 0).alias("kept"))
    # The number keeps filters on the verdict above this step: moved below, they would repeat the steps inside one another.
    df = df.select("row", F.when(F.monotonically_increasing_id() >= 0, judged).alias("quality"))
    return unpacked(df, events.columns, "quality")


def passed(events: DataFrame, rules: Sequence[Rule] = RULES, description: str = "description") -> DataFrame:
    """The events that break no rule, with their own columns."""
    name = "quality"
    while name.lower() in [c.lower() for c in events.columns]:
        name += "_"
    judged = quality_rules(events.withColumnRenamed("quality", name), rules,
                           name if description == "quality" else description)
    kept = judged.where("quality.kept").drop("quality")
    return kept.select(*[F.col(quoted(name if c == "quality" else c)).alias(c) for c in events.columns])
