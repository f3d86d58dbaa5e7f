"""Importance resampling of texts towards a target, on hashed n-gram counts (after Xie et al., 2023)."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm.columns import arrow_rows, given, quoted
from frostline.llm.infilling import drawn
from frostline.operators.ordered import running_totals
from frostline.session import cut_lineage

BUCKETS = 10_000
#: What separates words: every ASCII character but digits and letters. A-Z are lower-cased in the same pass.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def gram_pattern(n: int) -> regex.Pattern:
    """Runs of ``n`` words in bytes whose words are parted by single spaces; the look-arounds hold a run to whole words."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def gram_buckets(text: str, patterns: list[regex.Pattern], buckets: int = BUCKETS) -> list[int]:
    """Buckets of all runs of words that the patterns find, repeats included: their checksums modulo ``buckets``.

    Separators are collapsed to single spaces first, so that a run's span in the bytes is the run itself; overlapping
    matches begin at every word.
    """
    data = b" ".join(text.encode().translate(_FOLDED).split())
    spans = (match.span() for pattern in patterns for match in pattern.finditer(data, overlapped=True))
    return [crc32(data[a:b]) % buckets for a, b in spans]


def with_grams(texts: DataFrame, description: str, lengths: range, buckets: int) -> DataFrame:
    """Add ``n_words`` and ``grams``, the buckets of a text's runs as little-endian numbers in one binary."""
    patterns, kind = [gram_pattern(n) for n in lengths], _kind(buckets)

    def scan(columns: list[pa.Array]) -> list[pa.Array]:
        counts, found = [], []
        for text in columns[-1].to_pylist():
            counts.append(len(text.encode().translate(_FOLDED).split()))
            found.append(np.array(gram_buckets(text, patterns, buckets), kind).tobytes())
        return [pa.array(counts, pa.int64()), pa.array(found, pa.binary())]

    results = [T.StructField("n_words", T.LongType()), T.StructField("grams", T.BinaryType())]
    return arrow_rows(texts, {"text": given(description)}, results, scan)


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(grams: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how often each bucket occurs, summed within partitions first."""
    kind = _kind(buckets)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                count += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], ["bucket", "n"])

    return grams.select("grams").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(events: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket from the counts of both sides: 1000 times the log ratio of smoothed shares, floored."""
    s, t = events.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    every = events.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    df = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = df.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).head()
    one = F.lit(1.0)
    share = ((F.col("t") + one) * F.lit(float(sums["s"] + buckets))) / ((F.col("s") + one) * F.lit(float(sums["t"] + buckets)))
    return df.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))


def gumbel(number: Column) -> Column:
    """Gumbel noise of an unsigned 32-bit number, in thousandths, floored."""
    u = (number + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample_events(events: DataFrame, releases: DataFrame, event_id: str = "event_id", description: str = "description",
                    release_text: str = "text", *, min_n: int = 1, max_n: int = 1, buckets: int = BUCKETS,
                    min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Draw the traffic events whose descriptions read most like press releases: event_id, n_features, weight, score, rank.

    Features are all runs of ``min_n`` to ``max_n`` words; words are runs of letters, digits and characters beyond ASCII,
    A-Z lower-cased. A feature's bucket is the checksum of its bytes modulo ``buckets``. A bucket gains by the ratio of
    its smoothed shares in all releases and in all events; ``weight`` is the floored mean of the gains of a description's
    features (0 without any), and ``score`` adds Gumbel noise drawn from the seed and id, so that taking the highest
    scores draws without replacement by weight. Of the events with at least ``min_words`` words ``percent`` in a hundred
    (rounded down) are drawn and ranked 1, 2, 3, ... by falling score, then rising id; all others have no rank.

    Each row of ``events`` gives one row; other columns are left out. Null texts have no features; a null id is drawn as
    an empty one and comes last among ties; repeated rows are counted, and ranked one after the other. Without releases,
    or without events, the gains follow from the smoothing alone; an empty table of events gives an empty result.

    Descriptions are scanned once; their buckets are stored, two bytes a feature. Only the table of gains, ``buckets``
    numbers, goes through the driver to all tasks. Ranks come from range partitions of the candidates, so neither one
    score nor one id has to fit into a task.
    """
    lengths = range(min_n, max_n + 1)
    rows = events.select(F.col(quoted(event_id)).alias("event_id"), given(description).alias("text"))
    rows = cut_lineage(with_grams(rows, "text", lengths, buckets).select(
        "event_id", "n_words", "grams", F.monotonically_increasing_id().alias("row")), "grams")
    target = with_grams(releases.select(given(release_text).alias("text")), "text", lengths, buckets)
    table = bucket_gains(bucket_counts(rows, buckets), bucket_counts(target, buckets), buckets).toArrow().sort_by("bucket")
    gains = events.sparkSession.sparkContext.broadcast(table.column("gain").to_numpy())
    kind = _kind(buckets)

    def weigh(columns: list[pa.Array]) -> list[pa.Array]:
        found = [np.frombuffer(data, kind) for data in columns[-1].to_pylist()]
        sums = [(len(f), int(gains.value[f].sum()) // max(len(f), 1)) for f in found]
        return [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]

    results = [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]
    scored = arrow_rows(rows, {"grams": F.col("grams")}, results, weigh).select(
        "event_id", "row", "n_words", "n_features", "weight",
        (F.col("weight") + gumbel(drawn(F.col("event_id"), seed, 1))).alias("score"))
    return _ranked(cut_lineage(scored, "scored"), min_words, percent)


def _ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Add ``rank`` to the drawn rows. Scores are counted first, so that only rows down to the last drawn score are sorted."""
    able = F.col("n_words") >= min_words
    counts = cut_lineage(scored.where(able).groupBy("score").agg(F.count("*").alias("n")), "scores")
    wanted = (counts.agg(F.sum("n").alias("n")).head()["n"] or 0) * percent // 100
    columns = ["event_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    before = running_totals(counts, [], "score", ["n"], descending=True)
    lowest = before.where(F.col("n_before") < wanted).agg(F.min("score").alias("score")).head()["score"]
    near = able & (F.col("score") >= lowest)
    order = F.struct((-F.col("score")).alias("score"), F.col("event_id").isNull().alias("bare"), "event_id", "row")
    placed = running_totals(scored.where(near).select(*columns, order.alias("place"), F.lit(1).alias("one")), [], "place", ["one"])
    rank = F.col("one_before") + 1
    placed = placed.select(*columns, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    return placed.unionByName(scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
