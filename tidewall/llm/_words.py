"""Words of whole texts as NumPy arrays: byte bounds and 64-bit hashes, for use inside Arrow tasks.

A word is a longest run of bytes outside {0x20, 0x09-0x0D}. Texts are hashed in pieces of at most PIECE
bytes, cut between words, so that memory doesn't follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 4 << 20
_U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@cache
def _byte_codes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


BASE = 0x9E3779B97F4A7C15
GRAM = 0xD6E8FEB86659FD93
GRAM_INV = pow(GRAM, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_slices(ids: list, texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of rows with about `limit` bytes of text. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind, texts = np.int64, texts
    else:
        kind, texts = np.int32, texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and each text's first word with the count at the end. space: the bytes between words."""
    word = ~space[data]
    full = offsets[:-1][np.diff(offsets) > 0]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    start[full] = word[full]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with lower, of its bytes with A-Z lower-cased. About `piece` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, "right")))
        s, lens = starts[at:to], ends[at:to] - starts[at:to]
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        inside = np.arange(lens.sum()) - np.repeat(first, lens)
        part = data[np.repeat(s, lens) + inside]
        codes = _byte_codes()[LOWER[part] if lower else part]
        out[at:to] = np.add.reduceat(codes * powers(BASE, int(lens.max()))[inside], first)
        at = to
    return mix(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(GRAM, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(GRAM_INV, len(words) - n + 1))


def hashed_texts(ids: list, texts: pa.Array, lower: bool, piece: int = PIECE) -> Iterator[tuple[object, np.ndarray]]:
    """(id, word hashes) of every text; about `piece` bytes are at work at a time."""
    for some, data, offsets in text_slices(ids, texts, piece):
        starts, ends, first = word_bounds(data, offsets)
        hashes = hash_words(data, starts, ends, lower, piece)
        for k, i in enumerate(some):
            yield i, hashes[first[k] : first[k + 1]]
