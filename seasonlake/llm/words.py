"""Words and word shingles of a whole batch of texts, hashed in numpy.

Words are the runs between ASCII white space, with A-Z lower-cased; a shingle is ``size``
words in a row, and a text with fewer words is one shingle. Hashes have 64 bits: a
polynomial over random byte values, finished by a mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
SHORT = _random.integers(1, 1 << 63, 64, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text, end of each text's words)."""
    seen = ~SPACE[data]
    begins = seen.copy()
    begins[1:] &= ~seen[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = seen[inner]
    starts = np.flatnonzero(begins)
    first, last = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), first, last
    kept = data[seen]
    begin = np.flatnonzero(begins[seen])
    sizes = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, sizes)
    power = np.ones(int(sizes.max()), dtype=np.uint64)
    power[1:] = BASE
    power = np.cumprod(power, dtype=np.uint64)
    return mix(np.add.reduceat(BYTE[kept] * power[place], begin)), first, last


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; no words, no shingles."""
    words, first, last = hashed_words(*utf8(column))
    sums = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        sums += words[k : k + len(sums)] * STEPS[k]
    sums = mix(sums)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            s = np.sort(sums[a : b - size + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            total = np.append(words[a:b] * STEPS[: b - a], SHORT[b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([total], dtype=np.uint64)))
        else:
            out.append(sums[:0])
    return out
