"""Vectorised word hashing over whole batches of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text.  A batch of texts is laid
out as one byte array; every word gets a 64-bit hash from wrapped prefix sums,
so no Python object is made per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-byte random values, powers of the multiplier and of its inverse."""
    with np.errstate(over="ignore"):
        values = mix64(np.arange(1, 257, dtype=np.uint64))
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        powers = np.full(_CHUNK, _P)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverses = np.full(_CHUNK + 1, inverse)
        inverses[0] = 1
        np.multiply.accumulate(inverses, out=inverses)
    return values, powers, inverses


def _hash_chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of at most ``_CHUNK`` bytes."""
    values, powers, inverses = _tables()
    is_word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=total[1:])
    return start, end, (total[end] - total[start]) * inverses[start]


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offset and 64-bit hash of each word of a byte array."""
    with np.errstate(over="ignore"):
        if len(data) <= _CHUNK:
            start, end, h = _hash_chunk(data)
            return start, end, mix64(h ^ (end - start).astype(np.uint64))
        parts, at = [], 0
        while at < len(data):
            stop = min(at + _CHUNK, len(data))
            if stop < len(data):
                blanks = np.flatnonzero(SPACE[data[at:stop]])
                if not len(blanks):
                    return _hash_long(data)
                stop = at + int(blanks[-1]) + 1
            s, e, h = _hash_chunk(data[at:stop])
            parts.append((s + at, e + at, mix64(h ^ (e - s).astype(np.uint64))))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts))


def _hash_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For data holding a word longer than a chunk: a Horner-style pass in blocks."""
    values, powers, inverses = _tables()
    edge = np.flatnonzero(np.diff(~SPACE[data], prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    h = np.zeros(len(start), dtype=np.uint64)
    for i, (s, e) in enumerate(zip(start, end)):
        scale = np.uint64(1)
        for at in range(s, e, _CHUNK):
            block = data[at : min(e, at + _CHUNK)]
            h[i] += np.sum(values[block] * powers[: len(block)], dtype=np.uint64) * scale
            scale = scale * powers[_CHUNK - 1] * _P
    return start, end, mix64(h ^ (end - start).astype(np.uint64))


def batch_bytes(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts (None: empty) as one byte array, each followed by one blank.

    Also returns the offset of each text and, at the end, the total length.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    joined = b" ".join(raw) + b" "
    return np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8), bounds


def words_of(texts: list, lower: bool = False):
    """Hashes of all words of a batch, their byte range, each text's word range.

    Returns ``hash, start, end, first`` where text ``i`` has the words
    ``first[i]:first[i + 1]`` and offsets count within the batch's bytes, which
    come last.  ``lower`` maps A-Z to a-z first.
    """
    data, bounds = batch_bytes(texts, lower)
    start, end, h = hash_words(data)
    return h, start, end, np.searchsorted(start, bounds), data


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            out *= _P
            out += h[i : i + m]
        return mix64(out)
