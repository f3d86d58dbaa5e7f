"""Byte-level BPE: a lazily determinised transducer for encoding, and a UTF-8 state machine for streaming decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm.columns import arrow_rows, given, quoted
from frostline.llm.packing import PATTERN

STATE_LIMIT, PAIR_LIMIT, PIECE_LIMIT, PIECE_CHARS = 100_000, 250_000, 100_000, 64
LOOSE, SLOTS = 64, 524_287
BATCH_BYTES = 3 << 20
NODE_BITS = 24
NODE_MASK = (1 << NODE_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from lines of a base64 token and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """The merges behind a rank table, and which tokens may stand side by side in an encoding.

    Each token of several bytes is the merge of two tokens of lower rank: those that are left of its bytes when all
    merges of lower rank are done. So merges happen in the order of their ranks, and a token that ends up in the
    encoding was, at earlier times, seen from its border as a chain of ever smaller tokens. Two tokens stay apart if no
    pair over their border merges while both of its sides are there.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._chains: tuple[dict, dict] = {}, {}

    def merged(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """The parts of ``data`` after all merges of a rank less than ``below``, lowest rank first, then leftmost."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, rank: int) -> tuple[int, int] | None:
        """Ranks of the two tokens whose merge is this one, None for a single byte."""
        if rank not in self._parts:
            token = self.tokens[rank]
            if len(token) == 1:
                self._parts[rank] = None
            else:
                found = self.merged(token, rank)
                if len(found) != 2 or max(sides := (self.ranks[found[0]], self.ranks[found[1]])) >= rank:
                    raise ValueError(f"rank {rank} is not the merge of two tokens of lower rank")
                self._parts[rank] = sides
        return self._parts[rank]

    def chain(self, rank: int, side: int) -> list[tuple[bytes, float]]:
        """The tokens at the right (side 1) or left (0) border of a token while it grew: bytes, and the rank that ended it."""
        known = self._chains[side]
        if rank not in known:
            links, ended = [], float("inf")
            at: int | None = rank
            while at is not None:
                links.append((self.tokens[at], ended))
                inner = self.parts(at)
                at, ended = (inner[side], at) if inner else (None, ended)
            known[rank] = links
        return known[rank]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens remain unmerged beside each other.

        A pair over the border merges before either side is used otherwise. At equal ranks the left of two places goes
        first: that is the other merge if it lies in the left token, and the pair if it lies in the right one.
        """
        for x, x_ends in self.chain(left, 1):
            for y, y_ends in self.chain(right, 0):
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True


class Transducer:
    """Finite-state transducer from bytes to token ids, determinised as far as the texts need it.

    After each byte the encoding of what was read so far has one last token. A hypothesis says where the token that is
    being read began: it holds a context, which is the tokens before it that are not yet certain and the one just before
    it, and the node of the token trie reached by its bytes; both are numbers, in one integer. A state is the tuple of all
    hypotheses that may still become true, oldest first; those tokens on which all of them agree are put out on the way to
    it and belong to no state. A hypothesis dies when its trie path ends, so output lags by at most the longest token, and
    the number of states is finite.

    States and moves are made on need: where a move is missing, the hypotheses are followed one by one for up to ``LOOSE``
    bytes; only when it is found missing again soon is it made. So what occurs once costs no memory. Beyond
    ``STATE_LIMIT`` states the tables start again, which costs time but changes nothing.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        # The token trie: next node by node * 256 + byte, and per node its token (-1: none) and whether it goes on.
        self._next: dict[int, int] = {}
        self._token, self._inner = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self._inner[node] = True
                after = self._next.get(node << 8 | byte)
                if after is None:
                    after = self._next[node << 8 | byte] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(False)
                node = after
            self._token[node] = rank
        self._apart: dict[int, bool] = {}
        self._missed = array("q", [-1]) * SLOTS  # moves found missing of late, each in the place that its number gives
        self._start()

    def _start(self) -> None:
        self._contexts: dict[tuple[tuple[int, ...], int], int] = {}
        self._pending: list[tuple[int, ...]] = []
        self._last: list[int] = []
        self._longer: dict[int, int] = {}  # context * 2^NODE_BITS + token -> the context with that token behind it
        first = self._context((), -1) << NODE_BITS,
        self._numbers, self._states = {first: 0}, [first]
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._ends: list[tuple[int, ...]] = [()]

    def _context(self, pending: tuple[int, ...], last: int) -> int:
        number = self._contexts.get((pending, last))
        if number is None:
            number = self._contexts[pending, last] = len(self._last)
            self._pending.append(pending)
            self._last.append(last)
        return number

    def _fits(self, last: int, token: int) -> bool:
        pair = last << NODE_BITS | token
        fits = self._apart.get(pair)
        if fits is None:
            if len(self._apart) >= PAIR_LIMIT:
                self._apart.clear()
            fits = self._apart[pair] = last < 0 or self.merges.apart(last, token)
        return fits

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        going, done = [], -1
        follow, tokens, inner = self._next.get, self._token, self._inner
        for hypothesis in self._states[state]:
            after = follow((hypothesis & NODE_MASK) << 8 | byte)
            if after is None:
                continue
            context = hypothesis >> NODE_BITS
            token = tokens[after]
            if token >= 0 and done < 0 and self._fits(self._last[context], token):
                long = context << NODE_BITS | token
                done = self._longer.get(long, -1)
                if done < 0:
                    done = self._longer[long] = self._context(self._pending[context] + (token,), token)
            if inner[after]:
                going.append(context << NODE_BITS | after)
        if done < 0:
            raise ValueError("the rank table lacks a token for a single byte")
        going.append(done << NODE_BITS)
        number, sure = self._state(going)
        move = self._moves[state << 8 | byte] = (number, sure)
        return move

    def _state(self, going: list[int]) -> tuple[int, tuple[int, ...]]:
        """Number of the state of these hypotheses, and the tokens that all agree on."""
        sure: tuple[int, ...] = ()
        # The oldest hypothesis often has no uncertain token; then no token is certain yet for all.
        if self._pending[going[0] >> NODE_BITS]:
            held = [self._pending[h >> NODE_BITS] for h in going]
            sure = held[-1]
            for pending in held:
                while pending[:len(sure)] != sure:
                    sure = sure[:-1]
            if sure:
                going = [self._context(pending[len(sure):], self._last[h >> NODE_BITS]) << NODE_BITS | h & NODE_MASK
                         for pending, h in zip(held, going)]
        key = tuple(going)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
            self._ends.append(self._pending[going[-1] >> NODE_BITS])
        return number, sure

    def _follow(self, state: int, data: bytes) -> list[tuple[tuple[int, ...], int, int]]:
        """The hypotheses (uncertain tokens, token before the open one, node) after these bytes, without new states."""
        follow, tokens, inner, fits = self._next.get, self._token, self._inner, self._fits
        open_ = [(self._pending[h >> NODE_BITS], self._last[h >> NODE_BITS], h & NODE_MASK) for h in self._states[state]]
        for byte in data:
            going, done = [], None
            for pending, last, node in open_:
                after = follow(node << 8 | byte)
                if after is not None:
                    token = tokens[after]
                    if token >= 0 and done is None and fits(last, token):
                        done = pending + (token,), token, 0
                    if inner[after]:
                        going.append((pending, last, after))
            if done is None:
                raise ValueError("the rank table lacks a token for a single byte")
            going.append(done)
            open_ = going
        return open_

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(self._states) > STATE_LIMIT:
            self._start()
        moves, missed, state, out = self._moves, self._missed, 0, []
        at, end = 0, len(data)
        while at < end:
            key = state << 8 | data[at]
            move = moves.get(key)
            if move is None:
                if missed[key % SLOTS] != key:
                    missed[key % SLOTS] = key
                    open_ = self._follow(state, data[at:at + LOOSE])
                    at += LOOSE
                    if at >= end:
                        out += open_[-1][0]
                        return out
                    state, sure = self._state([self._context(pending, last) << NODE_BITS | node for pending, last, node in open_])
                    out += sure
                    continue
                move = self._move(state, data[at])
            state, sure = move
            if sure:
                out += sure
            at += 1
        out += self._ends[state]
        return out


class Encoder:
    """Token ids of many texts: each match of the pattern goes through the transducer alone.

    With ``PATTERN`` a match always begins at a blank before a character that is no white space, so texts are cut there
    first, and each distinct part of a batch is matched once. With another pattern a text is one part. Cuts are found in
    the bytes: those before a character that might be white space beyond ASCII are left out, which only makes parts
    longer. The ids of short pieces that come again soon are remembered, in two tables of ``PIECE_LIMIT`` pieces: when the
    newer one is full it becomes the older one, whose pieces move on when they are met.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self._transducer, self._pieces = Transducer(ranks), regex.compile(pattern)
        self._begins = np.full(256, pattern == PATTERN)
        self._begins[[*range(9, 14), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._met = array("q", [0]) * SLOTS  # hashes of pieces met of late

    def _parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds) of distinct parts."""
        ids, ends, known, older, met = array("I"), array("q", [0]), self._known, self._older, self._met
        split, encode = self._pieces.findall, self._transducer.encode
        for part in parts:
            for piece in split(part.decode()):
                found = known.get(piece)
                if found is None:
                    found = older.get(piece)
                    if found is not None:
                        known[piece] = found
                    else:
                        found = encode(piece.encode())
                        number = hash(piece)
                        if met[number % SLOTS] != number:
                            met[number % SLOTS] = number
                        elif len(piece) <= PIECE_CHARS:
                            known[piece] = tuple(found)
                ids.extend(found)
            ends.append(len(ids))
        return np.frombuffer(ids, np.uint32) if ids else np.empty(0, np.uint32), np.frombuffer(ends, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds): the ids of text ``i`` are ``ids[bounds[i]:bounds[i + 1]]``. There are no nulls in ``texts``."""
        if len(self._known) > PIECE_LIMIT:
            self._known, self._older = {}, self._known
        column = texts.cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1, 8 * column.offset)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[:edges[-1]]
        blanks = np.flatnonzero(data[:-1] == 0x20)
        begins = np.zeros(len(data) + 1, bool)
        begins[edges[:-1]] = True
        begins[blanks[self._begins[data[blanks + 1]]]] = True
        begins[:edges[0]] = begins[edges[-1]:] = False  # empty texts at the end have no part
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, edges[-1])
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), column.buffers()[2]])
        coded = parts.dictionary_encode()
        ids, ends = self._parts(coded.dictionary.to_pylist())
        numbers = coded.indices.to_numpy()
        lengths = np.diff(ends)[numbers]
        after = np.cumsum(lengths)
        flat = ids[np.repeat(ends[numbers] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]
        return flat, np.append(0, after)[np.searchsorted(starts, edges)]


# The well-formed byte ranges of UTF-8. For each first byte range, those of the bytes that follow.
TAIL = (0x80, 0xBF)
FORMS = (((0x00, 0x7F),), ((0xC2, 0xDF), TAIL), ((0xE0, 0xE0), (0xA0, 0xBF), TAIL), ((0xE1, 0xEC), TAIL, TAIL),
         ((0xED, 0xED), (0x80, 0x9F), TAIL), ((0xEE, 0xEF), TAIL, TAIL), ((0xF0, 0xF0), (0x90, 0xBF), TAIL, TAIL),
         ((0xF1, 0xF3), TAIL, TAIL, TAIL), ((0xF4, 0xF4), (0x80, 0x8F), TAIL, TAIL))
UNKNOWN = b"\xef\xbf\xbd"  # the replacement character


def utf8_machine() -> list[dict[int, int]]:
    """Moves of the machine: per state the next state by byte; state 0 lies between characters, no move is an error."""
    states, moves = {(): 0}, [{}]
    for head, *tail in FORMS:
        at, ahead = 0, head
        for k in range(len(tail) + 1):
            rest = tuple(tail[k:])
            if rest not in states:
                states[rest] = len(moves)
                moves.append({})
            moves[at].update(dict.fromkeys(range(ahead[0], ahead[1] + 1), states[rest]))
            at, ahead = states[rest], rest[0] if rest else head
    return moves


MACHINE = utf8_machine()


class Decoder:
    """Streaming decoder: takes token ids in any portions and gives only whole characters.

    The state between two calls is the machine's state and the bytes of an unfinished character. What a token does in a
    state is found byte by byte once and remembered, so a stream costs one look-up a token. Ill-formed bytes become the
    replacement character, one for each longest start of a character, as do an unfinished one at the end and unknown ids.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self._tokens = {rank: token for token, rank in ranks.items()}
        self._steps: dict[bytes, dict[int, tuple[bytes, bytes]]] = {b"": {}}
        self._open = b""

    @staticmethod
    def _run(data: bytes) -> tuple[bytes, bytes]:
        """Whole characters of ``data``, and the unfinished one at its end."""
        out, state, begun = bytearray(), 0, 0
        at = 0
        while at < len(data):
            after = MACHINE[state].get(data[at])
            if after is None:
                out += UNKNOWN
                # The byte that does not fit is tried again as the start of a character, unless it was at a start.
                at += state == 0
                state, begun = 0, at
                continue
            at += 1
            state = after
            if state == 0:
                out += data[begun:at]
                begun = at
        return bytes(out), data[begun:]

    def feed(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the characters that these ids complete."""
        out, open_ = [], self._open
        steps = self._steps[open_]
        for i in ids:
            step = steps.get(i)
            if step is None:
                if i in self._tokens:
                    step = self._run(open_ + self._tokens[i])
                else:
                    step = (UNKNOWN if open_ else b"") + UNKNOWN, b""
                steps[i] = step
            out.append(step[0])
            if step[1] != open_:
                open_ = step[1]
                steps = self._steps.setdefault(open_, {})
        self._open = open_
        return b"".join(out)

    def close(self) -> bytes:
        """What is left of the stream; the decoder then starts anew."""
        left, self._open = self._open, b""
        return UNKNOWN if left else b""

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.feed(ids) + self.close()


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process, so that later tasks find its states."""
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode_descriptions(events: DataFrame, ranks_path: str, description: str = "description", tokens: str = "tokens",
                        pattern: str = PATTERN, decoded: str | None = None) -> DataFrame:
    """Add the token ids of every traffic event's description, as little-endian unsigned 32-bit numbers in one binary.

    ``ranks_path`` names a rank file that every executor has; its tokens must be those of a merge order with all single
    bytes, and the pattern must cover every text. Whole texts are encoded, each match of the pattern by itself: in an
    encoding, merges go by rank, lowest first, then leftmost. With ``decoded``, a column of that name holds the text that
    the streaming decoder makes of the ids in the same pass, as ``decode_tokens`` would. Null and empty descriptions have
    no tokens (an empty binary). Given columns of the results' names are replaced; all other columns stay, whatever their
    names and values; repeated rows are each encoded; an empty table gives an empty result. No row leaves its task.
    """
    def encode(columns: list[pa.Array]) -> list[pa.Array]:
        ids, bounds = _encoder(ranks_path, pattern).ids(columns[-1])
        ids = ids.astype("<u4", copy=False)
        found = pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
        return [found] if decoded is None else [found, _texts(found, _decoder(ranks_path))]

    results = [T.StructField(tokens, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return arrow_rows(events, {"text": given(description)}, results, encode, BATCH_BYTES)


def _texts(tokens: pa.Array, decoder: Decoder, portion: int = 4096) -> pa.Array:
    """Text of each list of ids, decoded as a stream in portions of ids."""
    out = []
    for data in tokens:
        ids = np.frombuffer(data.as_buffer(), "<u4", len(data.as_buffer()) // 4)
        parts = [decoder.feed(ids[k:k + portion].tolist()) for k in range(0, len(ids), portion)]
        out.append(b"".join([*parts, decoder.close()]))
    return pa.array(out, pa.binary()).cast(pa.string())


def decode_tokens(encoded: DataFrame, ranks_path: str, tokens: str = "tokens", description: str = "description",
                  portion: int = 4096) -> DataFrame:
    """Add the text of token ids that ``encode_descriptions`` wrote, decoded as a stream in portions of ids.

    Null and empty tokens give an empty text; bytes that are no UTF-8 and unknown ids give replacement characters, and
    bytes after the last whole number are ignored. A given column of the result's name is replaced; all others stay.
    """
    data = F.coalesce(F.col(quoted(tokens)), F.lit(b""))
    return arrow_rows(encoded, {"data": data}, T.StructField(description, T.StringType()),
                      lambda columns: _texts(columns[-1], _decoder(ranks_path), portion), BATCH_BYTES)
