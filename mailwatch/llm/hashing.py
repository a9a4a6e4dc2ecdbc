"""Vectorised hashing of words and shingles over whole batches of texts.

A batch is laid out as one byte buffer, so that lower-casing, splitting and hashing are a few numpy
passes over it. Hashes have 64 bits; two different words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Bytes that separate words: space and \\t to \\r.
BLANKS = b" \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 2 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits (uint64 in, uint64 out)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


@cache
def _letters(lower: bool) -> np.ndarray:
    """A random value for every byte; A-Z share those of a-z when lower-casing."""
    table = stream(17, 256)
    if lower:
        table[65:91] = table[97:123]
    return table


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def batches(values: Sequence, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about limit bytes together; one longer text is a range of its own."""
    start = size = 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def word_hashes(texts: Sequence[bytes | None], blanks: bytes = BLANKS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the position of the first word of each text (with the total at the end)."""
    joined = b"".join(x for t in texts for x in (t or b"", b" "))
    buffer = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    if not len(buffer):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    blank = np.zeros(256, bool)
    blank[list(blanks)] = True
    gap = blank[buffer]
    gap[edges[1:] - 1] = True
    change = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    up, down = _powers(1 << max(16, int(len(buffer) - 1).bit_length()))
    with np.errstate(over="ignore"):
        running = np.cumsum(_letters(lower)[buffer] * up[: len(buffer)])
        before = np.where(starts > 0, running[starts - 1], np.uint64(0))
        hashes = mix((running[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, edges)


def shingle_hashes(words: np.ndarray, edges: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of size words that stays in one text; a shorter text is one run; with the edges of texts."""
    n = np.diff(edges)
    runs = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(runs)])
    factors = stream(29, size)
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        total = np.zeros(len(words), np.uint64)
        for j in range(size):
            total += padded[j : j + len(words)] * factors[j]
        firsts = np.repeat(edges[:-1] - out[:-1], runs) + np.arange(out[-1])
        hashes = mix(total[firsts]) if len(words) else np.empty(0, np.uint64)
        for i in np.flatnonzero((n > 0) & (n < size)):
            part = words[edges[i] : edges[i + 1]]
            hashes[out[i]] = mix((part * factors[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part)))
    return hashes, out


def byte_run_hashes(texts: Sequence[bytes], size: int, breaks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of size bytes without a break in it, and the number of the text it stands in."""
    joined = b"".join(x for t in texts for x in (t, breaks[:1]))
    buffer = np.frombuffer(joined, np.uint8)
    if len(buffer) <= size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    border = np.zeros(256, bool)
    border[list(breaks)] = True
    broken = np.concatenate([[0], np.cumsum(border[buffer])])
    starts = np.flatnonzero(broken[size:] == broken[:-size])
    up, down = _powers(1 << max(16, int(len(buffer) - 1).bit_length()))
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters(False)[buffer] * up[: len(buffer)])])
        hashes = mix((running[starts + size] - running[starts]) * down[starts])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.searchsorted(ends, starts, side="right")
