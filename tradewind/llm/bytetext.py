"""Words and substring hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

The word patterns of this package only ever separate on ASCII bytes, so working on bytes equals
working on characters. Texts are taken in chunks of bounded size, so memory follows the chunk (or
the one longest text), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# One random 64-bit value per byte; letters A-Z share the values of a-z in the folded table.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]

# Bytes outside [\x20\x09-\x0D].
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[[32, 9, 10, 11, 12, 13]] = False


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 65536
    while size < n:
        size *= 2
    return _powers(size)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [first, last) at a time with their bytes and offsets; a NULL is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    rows = len(texts)
    if not rows:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + rows + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = PLAIN_WORD):
    """Start, end and row of every word; a word never crosses a text's end."""
    inside = is_word[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | opens[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | opens[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


class Hashes:
    """Hashes of any substrings of one byte array, after one pass over it."""

    def __init__(self, data: np.ndarray, fold_case: bool = True):
        powers, self._inverse = _powers_for(len(data) + 1)
        values = (_FOLDED if fold_case else _VALUES)[data]
        values *= powers[: len(data)]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._sums[ends] - self._sums[starts]
        h *= self._inverse[starts]
        h += (ends - starts).astype(np.uint64) * _BASE
        return mix(h)


def window_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive word hashes; the caller drops those crossing texts."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _BASE
        total += word_hashes[k : k + n]
    return mix(total)


def hash_words(values: list[bytes]) -> np.ndarray:
    """The same hash for words given one by one."""
    if not values:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum([len(v) for v in values])
    starts = np.concatenate([[0], ends[:-1]])
    return Hashes(data).of(starts, ends)
