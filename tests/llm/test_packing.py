import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from frostline.llm import packing
from frostline.llm.queries import tokenizer_files
from tests.llm.samples import descriptions, events


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_files()[0])


TEXTS = [t or "" for _, t in descriptions()] + [
    " x", "x ", "  x", "a\n b", "a \nb", "  a  b", "a　 b", "don't  we'll 12 345!? éè \U0001f697 \U0001f697x",
    "<|endoftext|> a<|endoftext|>", "a <|endoftext|>", "\t", "A  B\n\n C"]


@pytest.mark.parametrize("fast", [False, True])
def test_ids_equal_those_of_whole_texts(tokenizer, fast):
    path, ranks = tokenizer_files()
    encoder = packing.Encoder(path, ranks if fast else None)
    for _ in range(2):
        ids, bounds = encoder.ids(pa.array(TEXTS))
        for i, text in enumerate(TEXTS):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [{}, {5: 3}, {1024: 7}, {600: 5, 424: 5}, {513: 10}, {1: 5000}, {341: 9, 342: 9, 1023: 2, 1: 2},
                                    {s: 1 + s % 7 for s in range(1, 1025)}])
def test_configurations_hold_exactly_the_pieces(counts):
    used = packing.configurations(counts)
    held = Counter()
    for lengths, times in used:
        assert 0 < sum(lengths) <= 1024 and times > 0
        for size in lengths:
            held[size] += times
    assert held == Counter(counts)
    total = sum(s * n for s, n in counts.items())
    assert sum(u.times for u in used) <= max(-(-total // 1024) * 1.02 + 2, sum(n for s, n in counts.items() if s > 512) + 1)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 400).tolist() * 2
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(1024 - size)
    assert sum(u.times for u in packing.best_fit(Counter(sizes), 1024)) == len(rooms)


def test_pieces_fill_sequences_without_gaps(spark, tokenizer):
    df = events(spark)
    path, ranks = tokenizer_files()
    got = packing.pack_events(df, path, ranks_path=ranks).collect()
    want = Counter()
    for i, text in descriptions():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["event_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 1024) + 2


def test_nothing_to_pack(spark):
    assert packing.pack_events(events(spark).where("false"), tokenizer_files()[0]).count() == 0
