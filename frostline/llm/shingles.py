"""Words and word shingles of Arrow text columns as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of each text, A-Z lower-cased, as one coded column and the bounds of the texts in it."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds -= bounds[0]
    if not filled.all():
        flat = flat.filter(pa.array(filled))
        bounds = np.concatenate([[0], np.cumsum(filled)])[bounds]
    return pc.dictionary_encode(flat), bounds


def word_hashes(coded: pa.DictionaryArray) -> np.ndarray:
    """64-bit hash of each distinct word."""
    buffer = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, buffer), np.uint64, len(buffer))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of all runs of ``k`` words, or of all words if there are fewer."""
    coded, bounds = word_lists(texts)
    flat = word_hashes(coded)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    n = len(flat)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j:j + len(rolled)] + np.uint64(j + 1))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a:b - k + 1]))
            elif b > a:
                one = np.zeros(1, np.uint64)
                for j, w in enumerate(flat[a:b]):
                    one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(j + 1))
                out.append(one ^ np.uint64(b - a))
            else:
                out.append(np.empty(0, np.uint64))
    return out
