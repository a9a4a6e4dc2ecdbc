"""A full-text index of words in minute space, searched in numpy for many words at once.

The suffixes of all words, each with its delimiter, are sorted; a pattern read from the end of the words
is an interval of suffix ranks, and one more symbol in front of it narrows the interval by two rank
look-ups. Words stored backwards are searched forwards, so the two directions are two indexes.
"""

from __future__ import annotations

import numpy as np

_STEP = 16


def _suffix_ranks(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes of each word up to its delimiter (code 0 at ``ends``); equal ones by place."""
    n = len(text)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    last = np.repeat(ends, sizes)
    rank, reach, longest = text.astype(np.int64), 1, int(sizes.max(initial=1))
    place = np.arange(n)
    while True:
        ahead = np.where(place + reach <= last, rank[np.minimum(place + reach, n - 1)] + 1, 0)
        key = rank * (n + 2) + ahead if reach < longest else rank
        order = np.argsort(key, kind="stable")
        if reach >= longest:
            return order
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        reach *= 2


class WordIndex:
    """Distinct words as byte strings without byte 0; ``backwards`` indexes them for reading from their first symbol."""

    def __init__(self, words: list[bytes], backwards: bool):
        self.words, self.backwards = words, backwards
        joined = np.frombuffer(b"".join(x for w in words for x in (w[::-1] if backwards else w, b"\0")), np.uint8)
        self.ends = np.cumsum([len(w) + 1 for w in words]) - 1
        self.symbols = np.unique(joined)
        codes = np.zeros(256, np.int64)
        codes[self.symbols] = np.arange(len(self.symbols))
        self.codes = np.full(256, -1, np.int64)
        self.codes[self.symbols] = np.arange(len(self.symbols))
        text = codes[joined]
        self.order = _suffix_ranks(text, self.ends)
        self.bwt = text[self.order - 1]  # what stands before the first word is a delimiter, the last symbol
        n, k = len(text), len(self.symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=k))])
        blocks = np.arange(n) // _STEP
        table = np.bincount(blocks * k + self.bwt, minlength=(n // _STEP + 1) * k).reshape(-1, k)
        self.before = np.concatenate([np.zeros((1, k), np.int64), np.cumsum(table, axis=0)]).astype(np.int32)
        self.padded = np.concatenate([self.bwt, np.full(_STEP, -1)])
        self.whole = np.flatnonzero(self.bwt == 0)

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = at // _STEP, at % _STEP
        near = self.padded[block[:, None] * _STEP + np.arange(_STEP)] == symbol[:, None]
        return self.before[block, symbol] + (near & (np.arange(_STEP) < rest[:, None])).sum(axis=1)

    def _ranks(self, at: np.ndarray) -> np.ndarray:
        block, rest = at // _STEP, at % _STEP
        k = len(self.symbols)
        near = self.padded[block[:, None] * _STEP + np.arange(_STEP)]
        rows, cols = np.nonzero(np.arange(_STEP) < rest[:, None])
        return self.before[block] + np.bincount(rows * k + near[rows, cols], minlength=len(at) * k).reshape(-1, k)

    def everything(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the delimiter alone, n times."""
        return np.zeros(n, np.int64), np.full(n, len(self.words), np.int64)

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol (a code, negative if the index has none); empty ones have low = high."""
        known = np.maximum(symbol, 0)
        lows, highs = self.first[known] + self._rank(known, low), self.first[known] + self._rank(known, high)
        return lows, np.where(symbol < 0, lows, highs)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, symbol, low, high) for every symbol but the delimiter that leaves an interval."""
        a, b = self._ranks(low), self._ranks(high)
        row, symbol = np.nonzero(b[:, 1:] > a[:, 1:])
        symbol += 1
        return row, symbol, self.first[symbol] + a[row, symbol], self.first[symbol] + b[row, symbol]

    def complete(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of the word that each interval spells from end to end, or -1."""
        a = np.searchsorted(self.whole, low)
        found = (a < len(self.whole)) & (self.whole[np.minimum(a, len(self.whole) - 1)] < high)
        rows = self.order[self.whole[np.minimum(a, len(self.whole) - 1)]]
        return np.where(found, np.searchsorted(self.ends, rows), -1)

    def holders(self, low: int, high: int) -> np.ndarray:
        """Numbers of the words whose suffixes are in the interval."""
        return np.searchsorted(self.ends, self.order[low:high])


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced symbol makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    i = int(differ[0]) if len(differ) else n
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def with_one_error(index: WordIndex, words: list[bytes], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, number of the indexed word) for all pairs that differ by one inserted, deleted or replaced symbol
    behind the ``exact`` first symbols read, which are the word's first ones if the index is backwards and its last ones otherwise.

    Each pair occurs once: of a run of equal symbols the last one counts as deleted, and a symbol is inserted behind its equals.
    Of words with over 32 symbols left, intervals of four words at most are compared with those words.
    """
    if not words or not index.words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(w if index.backwards else w[::-1] for w in words) + b"\0", np.uint8)
    flat = index.codes[flat]
    exact = np.asarray(exact)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def unsettled(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        few = (high - low <= 4) & (sizes[q] - at > 32)
        for j in np.flatnonzero(few):
            own, n = words[q[j]], int(exact[q[j]])
            for k in np.unique(index.holders(low[j], high[j])):
                other = index.words[k]
                alike = other[:n] == own[:n] if index.backwards else other[len(other) - n :] == own[len(own) - n :]
                if alike and one_apart(own, other):
                    found.append((np.array([q[j]]), np.array([k])))
        return ~few

    q = np.arange(len(words))
    low, high = index.everything(len(words))
    wrong = [np.empty(0, np.int64)] * 4
    at = 0
    while len(q) or len(wrong[0]):
        if len(wrong[0]):
            wq, pos, wl, wh = wrong
            ended = pos == sizes[wq]
            hit = index.complete(wl[ended], wh[ended])
            found.append((wq[ended][hit >= 0], hit[hit >= 0]))
            wq, pos, wl, wh = (x[~ended] for x in (wq, pos, wl, wh))
            wl, wh = index.extended(flat[begin[wq] + pos], wl, wh)
            wrong = [x[wl < wh] for x in (wq, pos + 1, wl, wh)]
        if len(q):
            free = at >= exact[q]
            new = []
            if free.any():
                fq, fl, fh = q[free], low[free], high[free]
                inside = at < sizes[fq]
                here = np.where(inside, flat[begin[fq] + np.minimum(at, sizes[fq] - 1)], -2)
                after = np.where(at + 1 < sizes[fq], flat[begin[fq] + np.minimum(at + 1, sizes[fq] - 1)], -3)
                less = inside & ((here != after) | (here < 0))
                new.append((fq[less], np.full(less.sum(), at + 1), fl[less], fh[less]))
                row, symbol, bl, bh = index.branches(fl, fh)
                other = symbol != here[row]
                row, bl, bh = row[other], bl[other], bh[other]
                new.append((fq[row], np.full(len(row), at), bl, bh))
                swap = inside[row]
                new.append((fq[row[swap]], np.full(swap.sum(), at + 1), bl[swap], bh[swap]))
            going = at < sizes[q]
            q, low, high = q[going], low[going], high[going]
            low, high = index.extended(flat[begin[q] + at], low, high)
            alive = low < high
            q, low, high = q[alive], low[alive], high[alive]
            at += 1
            wide = unsettled(q, low, high)
            q, low, high = q[wide], low[wide], high[wide]
            wrong = [np.concatenate([x, *(part[i] for part in new)]) for i, x in enumerate(wrong)]
    pairs = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)]), axis=1) if found else np.empty((2, 0), np.int64)
    return pairs[0].astype(np.int64), pairs[1].astype(np.int64)
