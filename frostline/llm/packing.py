"""Best-fit packing of tokenized texts into sequences of one length, by a configuration linear program."""

from __future__ import annotations

import base64
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.columns import given, quoted
from frostline.session import cut_lineage

LIMIT, END_ID = 1024, 2
ROUNDS, STEP, RATE = 60, 0.5, 0.7
CHUNK_BYTES = 8 << 20
KNOWN_LIMIT = 1_000_000  # remembered strings of one worker, then it starts again
# The split pattern of the byte-level vocabulary, and its special string.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
RANK_ROWS = 50_000


class Encoder:
    """Token ids of many texts, where each distinct string between blanks is tokenized once.

    The byte-level pattern always begins a token group at a blank before a character that is no white space, so texts
    are cut there and the parts are tokenized alone. A text where a blank stands beside other white space is tokenized
    as a whole. With ``ranks_path``, the same vocabulary as ranks, short parts go to the faster library, which gives the
    same ids; parts with the special string never do.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer, self._fast = Tokenizer.from_file(path), None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _encoded(self, parts: list[str]) -> list[list[int]]:
        if self._fast is None or any(SPECIAL in p for p in parts):
            return [e.ids for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return list(map(self._fast.encode_ordinary, parts))

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._used = np.empty(1 << 16, np.uint32), 0
        self._starts, self._lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _places(self, parts: list[str]) -> np.ndarray:
        """Number of each part in the table of remembered ids."""
        known = self._known
        missing = [p for p in dict.fromkeys(parts) if p not in known]
        for at in range(0, len(missing), 20_000):
            block = missing[at:at + 20_000]
            found = self._encoded(block)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
            first, number = len(known), len(known) + len(block)
            while self._used + len(flat) > len(self._ids):
                self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
            while number > len(self._starts):
                self._starts = np.concatenate([self._starts, np.empty_like(self._starts)])
                self._lengths = np.concatenate([self._lengths, np.empty_like(self._lengths)])
            self._ids[self._used:self._used + len(flat)] = flat
            self._starts[first:number] = self._used + np.cumsum(lengths) - lengths
            self._lengths[first:number] = lengths
            self._used += len(flat)
            known.update(zip(block, range(first, number)))
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds): ids of text ``i`` are ``ids[bounds[i]:bounds[i + 1]]``, without special tokens."""
        if len(self._known) > KNOWN_LIMIT:
            self._clear()
        n = len(texts)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = pc.dictionary_encode(lists.flatten())
        codes, parts = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        odd = np.fromiter((not p or p[0].isspace() for p in parts), bool, len(parts))
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        whole = np.add.reduceat((odd[codes] & ~first).astype(np.int64), bounds[:-1]) > 0
        inner = np.zeros(len(parts), bool)
        inner[codes[~first & ~np.repeat(whole, np.diff(bounds))]] = True
        place = np.zeros(len(parts), np.int64)
        used = np.flatnonzero(inner)
        place[used] = self._places([" " + parts[i] for i in used])
        numbers = place[codes]
        numbers[bounds[:-1]] = self._places(["" if w else parts[c] for c, w in zip(codes[bounds[:-1]], whole)])
        lengths = self._lengths[numbers]
        lengths[np.repeat(whole, np.diff(bounds))] = 0
        ends = np.cumsum(lengths)
        flat = self._ids[np.repeat(self._starts[numbers] - (ends - lengths), lengths) + np.arange(ends[-1] if n else 0)]
        sizes = np.add.reduceat(lengths, bounds[:-1])
        if whole.any():
            rows = np.flatnonzero(whole)
            apart = {int(i): np.asarray(e.ids, np.uint32) for i, e in zip(rows, self._tokenizer.encode_batch_fast(
                [texts[int(i)].as_py() for i in rows], add_special_tokens=False))}
            cut = np.split(flat, np.cumsum(sizes)[:-1])
            cut = [apart.get(i, c) for i, c in enumerate(cut)]
            flat, sizes = np.concatenate(cut), np.fromiter(map(len, cut), np.int64, n)
        return flat, np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=1)
def worker_encoder(path: str, ranks_path: str | None) -> Encoder:
    """One encoder a worker process, so that tasks after the first find frequent strings known."""
    return Encoder(path, ranks_path)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, at least one row.

    Parts are copies: lower-casing a slice of a text column reads its buffer from the wrong place.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, len(sizes)]):
        if b > a:
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


def token_pieces(events: DataFrame, tokenizer_path: str, event_id: str = "event_id", description: str = "description",
                 limit: int = LIMIT, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """Tokenize descriptions and cut the long ones: event_id, piece, start, length, ids_crc32.

    A text's ids are followed by ``end_id``. Texts of more than ``limit`` ids are cut into pieces of ``limit``; what is
    left over is the first piece. Null is an empty text, whose one piece is the end id.
    """
    df = events.select(F.col(quoted(event_id)).cast("long").alias("event_id"), given(description).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, ranks_path)
        for whole in batches:
            for batch in text_chunks(whole, "text"):
                ids, bounds = encoder.ids(batch.column("text"))
                rows: list[tuple[int, int, int, int, int]] = []
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    data = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    edge = len(data) % limit or limit
                    start, piece = 0, 0
                    while start < len(data):
                        rows.append((row, piece, start, edge - start, zlib.crc32(data[start:edge].tobytes())))
                        start, edge, piece = edge, edge + limit, piece + 1
                table = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("event_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)),
                     *[pa.array(table[:, k]) for k in (2, 3, 4)]], ["event_id", "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(cut, "event_id long, piece int, start long, length long, ids_crc32 long")


class Used(NamedTuple):
    """A configuration: pieces by length, how often it is used."""

    lengths: tuple[int, ...]
    times: int


def _best_fill(sizes: np.ndarray, prices: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best total price of each capacity, and the last size taken (0: none)."""
    best, took = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    upto = np.searchsorted(sizes, np.arange(limit + 1), side="right")
    for c in range(1, limit + 1):
        best[c], took[c] = best[c - 1], 0
        if upto[c]:
            gain = best[c - sizes[:upto[c]]] + prices[:upto[c]]
            at = int(np.argmax(gain))
            if gain[at] > best[c]:
                best[c], took[c] = gain[at], sizes[at]
    return best, took


def _filled(took: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
            room -= int(took[room])
        else:
            room -= 1
    return out


def fractional_configurations(counts: dict[int, int], limit: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """An approximate solution of the configuration program by multiplicative weights.

    The program covers each length as often as it occurs by the fewest configurations. Every length has a price, at
    first its size. Each round prices configurations by one knapsack over all capacities: for every length the best
    filling of the room it leaves. Configurations that share no length are raised together, and prices fall on lengths
    that are ahead of the average coverage and rise on those behind it.
    """
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(s)] for s in sizes], float)
    index = {int(s): i for i, s in enumerate(sizes)}
    weight, covered = np.ones(len(sizes)), np.zeros(len(sizes))
    x: dict[tuple[int, ...], float] = Counter()
    for _ in range(rounds):
        prices = sizes * weight
        best, took = _best_fill(sizes, prices, limit)
        worth = prices + best[limit - sizes]
        taken = np.zeros(len(sizes), bool)
        for i in np.lexsort((-sizes, -worth / (1 + covered))):
            if taken[i]:
                continue
            config = Counter([int(sizes[i]), *_filled(took, limit - int(sizes[i]))])
            rows = np.array([index[s] for s in config])
            if taken[rows].any():
                continue
            taken[rows] = True
            share = np.array(list(config.values())) / demand[rows]
            step = STEP / share.max()
            x[tuple(sorted(config.elements(), reverse=True))] += step
            covered[rows] += step * share
        behind = covered.mean() - covered
        weight = np.clip(weight * np.exp(RATE * behind / max(covered.mean(), 1e-9)), 1e-3, 1e3)
    scale = max(covered.mean(), 1e-9)
    return {k: v / scale for k, v in x.items()}


def best_fit(counts: dict[int, int], limit: int) -> list[Used]:
    """Best-fit decreasing on a histogram: equal sequences are kept as one group, so the work follows the lengths."""
    groups: dict[int, list[list]] = {}  # room left -> [lengths, times]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = next((r for r in range(size, limit + 1) if groups.get(r)), None)
            if room is None:
                each = limit // size
                for lengths, times in (((size,) * each, left // each), ((size,) * (left % each), 1)):
                    if lengths and times:
                        groups.setdefault(limit - sum(lengths), []).append([lengths, times])
                break
            lengths, times = groups[room].pop()
            put = min(left, times)
            if times > put:
                groups[room].append([lengths, times - put])
            groups.setdefault(room - size, []).append([lengths + (size,), put])
            left -= put
    return [Used(lengths, times) for same in groups.values() for lengths, times in same]


def configurations(counts: dict[int, int], limit: int = LIMIT) -> list[Used]:
    """Whole numbers of configurations that hold exactly the given lengths: the program rounded down, then best fit."""
    rest = {s: n for s, n in counts.items() if n > 0}
    used = [Used((limit,), rest.pop(limit))] if limit in rest else []
    if rest:
        x = fractional_configurations(rest, limit)
        for lengths, amount in sorted(x.items(), key=lambda kv: (sum(kv[0]) < limit, -kv[1], kv[0])):
            if sum(lengths) < limit:
                continue
            need = Counter(lengths)
            times = min(int(amount), *(rest.get(s, 0) // m for s, m in need.items()))
            if times > 0:
                used.append(Used(lengths, times))
                for s, m in need.items():
                    rest[s] -= times * m
    return used + best_fit({s: n for s, n in rest.items() if n > 0}, limit)


def _slots(used: list[Used]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times, offset): which ranks of a length go to which sequences."""
    rows, at, sequence = [], Counter(), 0
    for lengths, times in used:
        offset = 0
        for size, m in sorted(Counter(lengths).items(), reverse=True):
            rows.append((size, at[size], sequence, times, offset))
            at[size] += times * m
            offset += size * m
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack_events(events: DataFrame, tokenizer_path: str, event_id: str = "event_id", description: str = "description",
                limit: int = LIMIT, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """Pack the token ids of traffic event descriptions into few sequences of at most ``limit`` tokens.

    Result, a row per piece: event_id, piece, start, length, ids_crc32, sequence_id, offset. Every row of ``events`` is
    packed, repeated ones and those with a null id or text too; other columns are left out; an empty table gives an
    empty result. The driver sees the histogram of lengths, at most ``limit`` numbers, and solves the packing on it;
    its answer is a table of rank ranges whose size follows ``limit`` and the number of rounds, not the rows. Ranks
    within a length are counted per bucket of the rows and added up, so a very frequent length is spread over many tasks.
    """
    spark = events.sparkSession
    pieces = cut_lineage(
        token_pieces(events, tokenizer_path, event_id, description, limit, end_id, ranks_path), "pieces")
    n = pieces.count()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANK_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("event_id", "piece", "ids_crc32"), F.lit(buckets)))
    tally = cut_lineage(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(configurations(counts, limit)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("event_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("event_id", "piece", "start", "length", "ids_crc32",
                           (F.col("place") + F.col("before")).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = table[:, 0] * 2 ** 48 + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * 2 ** 48 + rank, side="right") - 1]
            since = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("event_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(row[:, 2] + since % row[:, 3]), pa.array(row[:, 4] + since // row[:, 3] * length)],
                ["event_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        put, "event_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
