"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.columns import given, hashed_grams, quoted, words

GRAM = 3
WINDOW = 12
_SPAN = 2 ** 31  # places in a packed number: positions are below it, hashes are 32 bits


def with_winnowed(df: DataFrame, tokens: str, out: str, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``: the chosen k-grams of the word array ``tokens`` as array<struct<position, hash>>, in order.

    Each run of ``window`` neighbouring k-grams gives its smallest hash, the rightmost one on ties; a choice shared by
    runs is kept once. Any passage of at least ``window + k - 1`` words that two texts share yields a common choice. A
    text with fewer k-grams than a window has one run; one with fewer than k words has a single gram of all its words;
    one without words has none.
    """
    short = F.when(F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, "\n")))).otherwise(
        F.array().cast("array<bigint>"))
    # The position is stored from the end, so that the smallest number is the smallest hash and its rightmost place.
    df = df.withColumn("_packed", F.transform(
        F.when(F.size(tokens) < k, short).otherwise(hashed_grams(F.col(tokens), k)),
        lambda h, i: F.shiftrightunsigned(h, 33) * _SPAN + (_SPAN - 1 - i)))
    packed = F.col("_packed")
    runs = F.slice(packed, 1, F.greatest(F.size(packed) - (window - 1), F.least(F.size(packed), F.lit(1))))
    df = df.withColumn("_chosen", F.array_distinct(F.transform(
        runs, lambda p, i: F.array_min(F.slice(packed, i + 1, window)))))
    return df.withColumn(out, F.transform("_chosen", lambda v: F.struct(
        (_SPAN - 1 - F.pmod(v, F.lit(_SPAN))).alias("position"),
        F.shiftright(v, 31).alias("hash")))).drop("_packed", "_chosen")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda f: f["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct hashes, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(fingerprint: Column) -> Column:
    """``position:hash`` pairs in order, joined by blanks; hashes in base 16."""
    return F.array_join(F.transform(fingerprint, lambda f: F.concat(
        f["position"].cast("string"), F.lit(":"), F.lower(F.hex(f["hash"])))), " ")


def winnow(events: DataFrame, description: str = "description", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``fingerprint``, the winnowed k-grams of every event's whole description with their word positions.

    A given column of that name is replaced. Null counts as an empty text, whose fingerprint is empty; equal texts have
    equal fingerprints. No row leaves its task.
    """
    kept = [c for c in events.columns if c.lower() != "fingerprint"]
    df = events.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row") if kept else F.lit(None).alias("row"),
                       words(given(description)).alias("tokens"))
    df = with_winnowed(df, "tokens", "fingerprint", k, window)
    return df.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in kept], "fingerprint")


def successors(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """(event_id, next_id) of each distinct id that is not null; the last one is followed by the first.

    Ids are cut into ranges at sampled quantiles; only the first id of each range is looked up across ranges. Only ids
    are shuffled, and no task sorts more than about a range.
    """
    spark = events.sparkSession
    ids = events.select(F.col(quoted(event_id)).alias("id")).where("id is not null").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(ids.agg(F.percentile_approx("id", shares, 10000)).head()[0] or [])) if shares else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    ranged = ids.withColumn("part", place)
    firsts = [r for r in ranged.groupBy("part").agg(F.min("id").alias("first")).orderBy("part").collect()]
    if not firsts:
        return ids.select(F.col("id").alias("event_id"), F.col("id").alias("next_id"))
    follow = {a["part"]: b["first"] for a, b in zip(firsts, firsts[1:] + firsts[:1])}
    after = F.element_at(F.create_map(*[F.lit(x) for kv in follow.items() for x in kv]), F.col("part"))
    step = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.select(F.col("id").alias("event_id"), F.coalesce(step, after).alias("next_id"))


def edited_fingerprints(events: DataFrame, event_id: str = "event_id", description: str = "description",
                        k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint every description and an edited one: its last quarter replaced by the start of the next event's.

    The last floor(n/4) of n code points give way to as many first ones (or all) of the event with the next higher id;
    the last is followed by the first. Result: event_id, n_chars, edited (text), fingerprint, edited_fingerprint,
    near_edited and near_next, the likeness of the fingerprint to the edited text's and to the next event's. Ids must be
    integers. A null description is empty. Rows that repeat an id each give a row and share a successor; of several
    next ones the smallest text is taken. A row with a null id has no successor: its last quarter is just cut off and
    ``near_next`` is 0. Texts are shuffled once, and of the next event only the start that is needed and its hashes.
    """
    every = events.select(F.col(quoted(event_id)).cast("long").alias("event_id"), given(description).alias("text"))
    base = every.where("event_id is not null")
    lengths = base.groupBy("event_id").agg(F.max(F.floor(F.length("text") / 4)).alias("wanted"))
    asked = successors(base.select("event_id")).join(lengths, "event_id").select(
        F.col("event_id").alias("asker"), F.col("next_id").alias("event_id"), "wanted")
    # Both joins read the same rows by id, so that one shuffle of the texts serves both; fingerprints are made behind it.
    heads = with_winnowed(base.join(asked, "event_id").withColumn("tokens", words(F.col("text"))), "tokens", "print", k, window)
    heads = heads.groupBy("asker").agg(F.min(F.struct(
        F.substring(F.col("text"), F.lit(1), F.col("wanted").cast("int")).alias("head"),
        F.transform(hashes(F.col("print")), lambda h: h.cast("int")).alias("next_hashes"))).alias("next"))
    df = base.join(heads.select(F.col("asker").alias("event_id"), "next.*"), "event_id", "left")
    df = df.unionByName(every.where("event_id is null"), allowMissingColumns=True)
    df = with_winnowed(df.withColumn("tokens", words(F.col("text"))), "tokens", "fingerprint", k, window)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4)
    df = df.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - tail).cast("int")),
        F.substring(F.coalesce("head", F.lit("")), F.lit(1), tail.cast("int"))))
    df = with_winnowed(df.withColumn("tokens", words(F.col("edited"))), "tokens", "edited_fingerprint", k, window)
    df = df.withColumn("_own", F.transform(hashes(F.col("fingerprint")), lambda h: h.cast("int")))
    edited = F.transform(hashes(F.col("edited_fingerprint")), lambda h: h.cast("int"))
    return df.select("event_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                     likeness(F.col("_own"), edited).alias("near_edited"),
                     F.coalesce(likeness(F.col("_own"), F.col("next_hashes")), F.lit(0.0)).alias("near_next"))
