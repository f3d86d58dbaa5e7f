"""Hidden Markov language model: Baum-Welch counts over all partitions, exact likelihood by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.columns import given, quoted
from frostline.llm.packing import text_chunks
from frostline.llm.shingles import word_lists
from frostline.session import cut_lineage

STATES, PASSES, TURNS = 10, 2, 32  # passes over all training texts, after one that takes them in TURNS turns
LEXICON, ENDINGS = 6000, 2048  # frequent words with a symbol of their own; classes of the other words, by their ending
COUNTED = 100_000  # words whose counts every task holds; the counts of the others are joined
WINDOW, MARGIN, TOGETHER = 384, 16, 512  # tokens counted in a window, tokens seen on each side of them; windows at a time
END = ""  # the end of a text, counted as a token; no word is empty
_TRUST = 2.0  # weight of the overall symbol shares in a state's emissions


class Words(NamedTuple):
    """What every task knows of the training counts; bounded by LEXICON, ENDINGS and COUNTED."""

    counts: dict[str, int]
    symbols: dict[str, int]
    class_log: np.ndarray  # log10 of tokens + words + 1 of each class of endings
    shares: np.ndarray  # share of each symbol in the training tokens
    total: int
    distinct: int
    least: int  # words with fewer training tokens are not in ``counts``


class Model(NamedTuple):
    """First-state shares, transitions, and emissions (symbol, state)."""

    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def ending(word: str) -> int:
    """Class of a word outside the lexicon: by its last three bytes."""
    return zlib.crc32(word.encode()[-3:]) % ENDINGS


def training_counts(events: DataFrame, description: str) -> DataFrame:
    """(word, n) over all training texts, with a row for the end; partial sums are taken batch by batch."""
    df = events.select(given(description).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "text"):
                coded, _ = word_lists(batch.column("text"))
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*coded.dictionary.to_pylist(), END], pa.string()),
                     pa.array(np.append(n, batch.num_rows).astype(np.int64))], ["word", "n"])

    return df.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame) -> Words:
    """Totals, the frequent words, and the sums of each class of endings, from the table of counts.

    The least count of a held word is an edge of a logarithmic histogram, so that at most COUNTED words are held.
    """
    spark = counts.sparkSession
    level = F.floor(F.log(F.col("n").cast("double")) * 4).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least"))
    held, least, total, distinct = 0, None, 0, 0
    full = False
    for r in sorted(levels.collect(), key=lambda r: -r["level"]):
        total, distinct = total + r["n"], distinct + r["words"]
        full = full or held + r["words"] > COUNTED
        if not full:
            held, least = held + r["words"], r["least"]
    least = least if least is not None else 2 ** 62
    table = counts.where(F.col("n") >= least).toArrow()
    pairs = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()), key=lambda p: (-p[1], p[0]))
    lexicon = [END, *[w for w, _ in pairs if w != END][:LEXICON]]
    own = spark.sparkContext.broadcast(set(lexicon))

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            kind = np.fromiter((-1 if w in own.value else ending(w) for w in words), np.int64, len(words))
            rest = kind >= 0
            tokens = np.bincount(kind[rest], n[rest], ENDINGS).astype(np.int64)
            each = np.bincount(kind[rest], minlength=ENDINGS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(tokens), pa.array(each)],
                                             ["ending", "tokens", "words"])

    sums = counts.mapInArrow(endings, "ending long, tokens long, words long").groupBy("ending").agg(
        F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    tokens, each = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in sums.collect():
        tokens[r["ending"]], each[r["ending"]] = r["tokens"], r["words"]
    held_counts = dict(pairs)
    seen = np.concatenate([[held_counts.get(w, 0) for w in lexicon], tokens]) + 0.01
    return Words(held_counts, {w: i for i, w in enumerate(lexicon)}, np.log10(tokens + each + 1), seen / seen.sum(), total, distinct,
                 least)


def encoded(events: DataFrame, words: Words, event_id: str, description: str, train: str) -> DataFrame:
    """Every text as symbols, with the sums that follow from held counts and the words whose counts must be joined.

    row (a number that stays with the stored row), event_id, train, n_tokens, n_known, log_counts (sum of log10(c + 1)
    of held words), class_logs (of the tokens that are no symbol: the same sum, less the logarithm of their class),
    symbols (int16 bytes), rest (array of word, tokens and whether it is no symbol).
    """
    df = events.select(F.col(quoted(event_id)).cast("long").alias("event_id"), F.coalesce(F.col(quoted(train)), F.lit(False)).alias(
        "train"), given(description).alias("text"))
    shared = events.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        base = len(held.symbols)
        number = (TaskContext.get().partitionId()) << 40
        end_log, end_known = np.log10(held.counts.get(END, 0) + 1), int(held.counts.get(END, 0) > 0)
        for whole in batches:
            for batch in text_chunks(whole, "text"):
                coded, bounds = word_lists(batch.column("text"))
                distinct = coded.dictionary.to_pylist()
                symbol = np.fromiter((held.symbols.get(w, -1) for w in distinct), np.int64, len(distinct))
                other = symbol < 0
                symbol[other] = [base + ending(w) for w, o in zip(distinct, other) if o]
                count = np.fromiter((held.counts.get(w, -1) for w in distinct), np.int64, len(distinct))
                far = count < 0
                log = np.where(far, 0.0, np.log10(np.maximum(count, 0) + 1.0))
                inside = np.zeros(len(distinct))
                inside[other] = log[other] - held.class_log[symbol[other] - base]
                code = coded.indices.to_numpy().astype(np.int64)
                sums = [np.concatenate([[0.0], np.cumsum(v[code])])[bounds] for v in (log, inside, (~far).astype(float))]
                logs, insides, knowns = (np.diff(s) for s in sums)
                tokens = np.diff(bounds)
                flat = np.insert(symbol[code], bounds[1:], 0).astype("<i2")
                edges = bounds + np.arange(len(bounds))
                at = np.flatnonzero(far[code])
                text_of = np.searchsorted(bounds, at, side="right") - 1
                pairs, times = np.unique(text_of * len(distinct) + code[at], return_counts=True) if len(at) else (
                    np.empty(0, np.int64), np.empty(0, np.int64))
                word_of = pairs % max(len(distinct), 1)
                lists = np.searchsorted(pairs, np.arange(len(tokens) + 1) * max(len(distinct), 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays(
                    [coded.dictionary.take(pa.array(word_of)).cast(pa.string()), pa.array(times.astype(np.int64)),
                     pa.array(other[word_of])], ["word", "tokens", "apart"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(len(tokens))), batch.column("event_id"), batch.column("train"),
                    pa.array(tokens + 1), pa.array((knowns.round().astype(np.int64) + end_known)), pa.array(logs + end_log),
                    pa.array(insides), pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists), rest)],
                    ["row", "event_id", "train", "n_tokens", "n_known", "log_counts", "class_logs", "symbols", "rest"])
                number += len(tokens)

    return df.mapInArrow(encode, "row long, event_id long, train boolean, n_tokens long, n_known long, log_counts double, "
                                 "class_logs double, symbols binary, rest array<struct<word string, tokens long, apart boolean>>")


def windows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all symbols, start, length, lead, stop) of the windows of whole sequences.

    A window counts its places lead to stop; every symbol is counted in one window. Up to MARGIN symbols on either side
    are seen as well, so that the states at a cut know their neighbours, and the transition over it is counted too.
    """
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    offset = np.cumsum(sizes) - sizes
    each = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(sizes)), each)
    core = (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
    begin, core_end = np.maximum(core - MARGIN, 0), np.minimum(core + WINDOW, sizes[of])
    return (np.concatenate(sequences).astype(np.int64) if len(sequences) else np.empty(0, np.int64), offset[of] + begin,
            np.minimum(core_end + MARGIN, sizes[of]) - begin, core - begin, core_end - begin)


def settled(moves: np.ndarray) -> np.ndarray:
    """State shares that the transitions leave as they are; what a window that opens inside a text starts from."""
    return np.linalg.matrix_power(moves, 256).mean(axis=0)


def expected_counts(model: Model, sequences: list[np.ndarray]) -> Model:
    """Expected first states, transitions and emissions of one step, in the shape of the model."""
    flat, start, length, lead, stop = windows(sequences)
    order = np.argsort(-length, kind="stable")
    k, out, inner = len(model.first), Model(*[np.zeros_like(a) for a in model]), settled(model.moves)
    for at in range(0, len(order), TOGETHER):
        some = order[at:at + TOGETHER]
        begin, size, opens = start[some], length[some], lead[some] == 0
        active = [int(n) for n in np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")]
        alphas, scales, emitted, seen = [], [], [], []
        for t, n in enumerate(active):
            symbol = flat[begin[:n] + t]
            e = model.emits[symbol]
            a = (np.where(opens[:, None], model.first, inner) if t == 0 else alphas[-1][:n] @ model.moves) * e
            scale = a.sum(axis=1, keepdims=True)
            alphas.append(a / scale)
            scales.append(scale)
            emitted.append(e)
            seen.append(symbol)
        gammas, beta = [None] * len(active), np.ones((active[-1], k))
        moves = np.zeros((k, k))
        for t in range(len(active) - 1, -1, -1):
            n, a = active[t], alphas.pop()
            counted = ((lead[some[:n]] <= t) & (t < stop[some[:n]]))[:, None]
            if t + 1 < len(active):
                m = active[t + 1]
                ahead = emitted.pop() * beta / scales.pop()
                moves += a[:m].T @ (ahead * into)  # transitions into the counted places of the next step
                beta = np.ones((n, k))
                beta[:m] = ahead @ model.moves.T
            gammas[t], into = a * beta * counted, counted
        out.moves[...] += moves * model.moves
        out.first[...] += gammas[0][opens].sum(axis=0)
        gamma, symbol = np.concatenate(gammas), np.concatenate(seen)
        for s in range(k):
            out.emits[:, s] += np.bincount(symbol, gamma[:, s], len(model.emits))
    return out


def updated(counts: Model, shares: np.ndarray) -> Model:
    """Parameters from expected counts; emissions keep a little of the overall symbol shares, so that none is 0."""
    emits = counts.emits + _TRUST * len(shares) ** 0.5 * shares[:, None]
    moves = counts.moves + 0.1

    def scaled(v):
        return (v + 0.1) / (v + 0.1).sum()

    return Model(scaled(counts.first), moves / moves.sum(axis=1, keepdims=True),
                 emits / emits.sum(axis=0))


def opening_model(shares: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    random = np.random.default_rng(seed)
    emits = shares[:, None] * random.gamma(1.0, 1.0, (len(shares), states)) + 1e-9
    moves = np.full((states, states), 1.0) + 2.0 * np.eye(states)
    return Model(np.full(states, 1.0 / states), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64) if len(order) else np.empty(0, np.int64)
    size = sizes[order]
    begin, total = np.cumsum(size) - size, np.zeros(len(order))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    a = np.empty((0, len(model.first)))
    for t in range(longest):
        n = int(active[t])
        a = (model.first if t == 0 else a[:n] @ model.moves) * model.emits[flat[begin[:n] + t]]
        scale = a.sum(axis=1)
        total[:n] += np.log10(scale)
        a /= scale[:, None]
    out = np.empty(len(order))
    out[order] = total
    return out


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i2") for b in column.to_pylist()]


def baum_welch(texts: DataFrame, shares: np.ndarray, states: int = STATES, passes: int = PASSES) -> Model:
    """Train on ``row`` and ``symbols`` of all given texts, whose symbols have these shares.

    An opening pass takes the texts in TURNS turns by their row, and each turn moves the model by the expected counts of
    its own texts. Each of the ``passes`` then sums the expected counts of every text. All sums are taken over all
    partitions; states times symbols numbers come back. A turn without texts changes nothing.
    """
    spark, n_symbols = texts.sparkSession, len(shares)
    model = opening_model(shares, states)
    turns = [texts.where(F.pmod("row", F.lit(TURNS)) == turn) for turn in range(TURNS)]
    for some in [*turns, *[texts] * passes]:
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, sums = shared.value, None
            for batch in batches:
                if batch.num_rows:
                    got = expected_counts(m, _sequences(batch.column("symbols")))
                    sums = got if sums is None else Model(*[a + b for a, b in zip(sums, got)])
            if sums is not None:
                flat = np.concatenate([a.reshape(-1) for a in sums])
                place = np.flatnonzero(flat > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], ["place", "n"])

        sums = some.select("symbols").mapInArrow(expect, "place long, n double").groupBy("place").agg(
            F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        if not sums.num_rows:
            continue
        flat = np.zeros(states + states ** 2 + n_symbols * states)
        flat[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
        first, moves, emits = np.split(flat, np.cumsum([states, states ** 2]))
        model = updated(Model(first, moves.reshape(states, states), emits.reshape(n_symbols, states)), shares)
    return model


def language_scores(events: DataFrame, train: str, event_id: str = "event_id", description: str = "description",
                    states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Score every description by a language model that learns from the rows where the column ``train`` is true.

    Result, a row per event: event_id, train, n_tokens, n_known (tokens with c > 0), train_tokens (N), base_score (sum of
    log10((c + 1) / (N + V + 1))) and score, the model's log10 probability of the text. Tokens are the words (runs without
    ASCII white space, A-Z lower-cased) and one end; c, N and V are the token's count, all tokens, and distinct tokens in
    training.

    States emit symbols: the LEXICON most frequent words, the end, and ENDINGS classes of the other words; a class gives
    one of its words with (c + 1) / (tokens + words + 1) of the class, and leaves the rest to unseen ones. So the state
    tables have a fixed size while the counts grow with the corpus. The forward recursion runs over the whole text;
    training runs over windows that count WINDOW tokens each and see MARGIN more on both sides, so that every token and every
    transition of every training text counts once in the opening pass and in each of the ``passes``.

    Counts cover all training texts. Those of at most COUNTED frequent words are held by every task, the counts of all
    other words are joined. Null texts are empty and hold only the end; null in ``train`` counts as false; repeated rows
    are texts of their own; without training rows all counts are 0; other columns are left out.
    """
    counts = cut_lineage(training_counts(events.where(F.coalesce(F.col(quoted(train)), F.lit(False))), description), "lm-counts")
    words = known_words(counts)
    texts = cut_lineage(encoded(events, words, event_id, description, train), "lm-symbols")
    shared = events.sparkSession.sparkContext.broadcast(baum_welch(texts.where("train"), words.shares, states, passes))

    # The likelihood goes with its row, so that the sums need no second join.
    kept = ["row", "event_id", "train", "n_tokens", "n_known", "log_counts", "class_logs"]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = log_likelihoods(shared.value, _sequences(batch.column("symbols")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(got, pa.float64())],
                                             [*kept, "likelihood"])

    scored = texts.select(*kept, "symbols").mapInArrow(
        beside, "row long, event_id long, train boolean, n_tokens long, n_known long, log_counts double, class_logs double, "
                "likelihood double")
    rest = texts.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(
        counts.where(F.col("n") < words.least).select(F.col("word").alias("of"), "n"), F.col("word") == F.col("of"), "left")
    n = F.coalesce("n", F.lit(0))
    log = F.col("tokens") * F.log10(n + 1.0)
    rest = rest.groupBy(F.col("row").alias("of_row")).agg(
        F.sum(F.when(n > 0, F.col("tokens")).otherwise(0)).alias("more_known"), F.sum(log).alias("more_log"),
        F.sum(F.when(F.col("apart"), log).otherwise(0.0)).alias("more_class"))
    df = scored.join(rest, F.col("row") == F.col("of_row"), "left")

    def with_rest(name, more):
        return F.col(name) + F.coalesce(more, F.lit(0))

    spread = float(np.log10(words.total + words.distinct + 1))
    return df.select(
        "event_id", "train", "n_tokens", with_rest("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (with_rest("log_counts", "more_log") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("likelihood") + with_rest("class_logs", "more_class")).alias("score"))
