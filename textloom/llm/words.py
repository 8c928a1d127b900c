"""Words and word runs of whole Arrow batches as 64-bit hashes, without a Python loop over words.

Words are runs of letters and digits, case ignored. Each distinct word of a batch is
hashed once; runs of words combine the hashes with array arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

RUN = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, one after the other, and the offset where each text's words begin.

    The offsets have one entry more than there are texts; null texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+")
    flat = lists.flatten()
    starts = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    some = pc.not_equal(pc.binary_length(flat), 0)
    mask = np.asarray(some.to_numpy(zero_copy_only=False), dtype=bool)
    if not mask.all():
        flat = flat.filter(some)
        starts = np.concatenate([[0], np.cumsum(mask)])[starts]
    return flat.dictionary_encode(), starts


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and the offsets of the texts."""
    words, starts = split_words(texts)
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    codes = words.indices.to_numpy(zero_copy_only=False)
    return (of[codes] if len(codes) else np.zeros(0, np.uint64)), starts


def runs(hashes: np.ndarray, starts: np.ndarray, length: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of so many words within a text, in order, and the offsets of the texts."""
    sizes = np.maximum(np.diff(starts) - (length - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = len(hashes) - (length - 1)
    if n <= 0 or not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    with np.errstate(over="ignore"):
        value = np.zeros(n, np.uint64)
        for k in range(length):
            value = value * _BASE + hashes[k : k + n]
        value = mix(value)
    return value[positions(starts[:-1], sizes)], offsets


def positions(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... so many as sizes[0], then those from begins[1], and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - sizes), sizes)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The number of the text for each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def distinct_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, and the new offsets."""
    who = owners(offsets)
    order = np.lexsort((values, who))
    values, who = values[order], who[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (who[1:] != who[:-1])
    sizes = np.bincount(who[new], minlength=len(offsets) - 1)
    return values[new], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def window_minima(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` consecutive values within a text, and the offsets."""
    n = len(values) - (width - 1)
    sizes = np.maximum(np.diff(offsets) - (width - 1), 0)
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if n <= 0 or not out[-1]:
        return np.zeros(0, np.uint64), out
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least[positions(offsets[:-1], sizes)], out
