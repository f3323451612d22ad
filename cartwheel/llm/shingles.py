"""Hashed word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed together up to so many bytes (one longer text by itself).
CHUNK_BYTES = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        out[have:2 * have] = out[:min(have, n - have)] * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of chunks of bounded size; null counts as empty."""
    first, part, size = 0, [], 0
    for row, t in enumerate(texts):
        data = t.as_buffer().to_pybytes() if t.is_valid else b""
        if part and size + len(data) > CHUNK_BYTES:
            yield first, part
            first, part, size = row, [], 0
        part.append(data)
        size += len(data)
    if part:
        yield first, part


def sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``width`` words.

    A-Z are lower-cased; words are runs without ASCII white space.  A text with fewer
    words has the whole sequence as one shingle, one without words has none.
    """
    flat = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[flat]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begins):
        return [np.zeros(0, np.uint64) for _ in texts]
    span = np.diff(np.append(begins, len(flat)))
    place = np.arange(begins[0], len(flat)) - np.repeat(begins, span)
    word = np.add.reduceat(_VALUE[flat[begins[0]:]] * _powers(int(span.max()))[place], begins - begins[0])
    word = mixed(word)
    ends = np.cumsum([len(t) + 1 for t in texts])
    stop = np.searchsorted(begins, ends)
    out, start = [], 0
    weights = [np.uint64(pow(_BASE, 3 * k + 1, 1 << 64)) for k in range(width)]
    n = len(word) - width + 1
    grams = mixed(sum(word[k:k + n] * w for k, w in enumerate(weights))) if n > 0 else word[:0]
    for end in stop.tolist():
        have = end - start
        if have >= width:
            out.append(np.unique(grams[start:end - width + 1]))
        elif have:
            short = (word[start:end] * np.array(weights[:have], np.uint64)).sum(keepdims=True)
            out.append(mixed(short ^ np.uint64(0x5555 + have)))
        else:
            out.append(word[:0])
        start = end
    return out
