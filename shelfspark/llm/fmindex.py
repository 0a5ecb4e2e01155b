"""A compressed full-text index over words: BWT in a wavelet matrix, rank
directories, backward search, and matching statistics of streamed patterns.

The text is a set of pieces with a separator (symbol 0) after each. Suffixes are
sorted by their first ``depth`` symbols, which is enough for matches shorter
than that: the rows that start with a match are one interval in such an order,
and a backward step finds the next interval by counting alone. Where no row goes
on with the next symbol, the match gives up its last symbols: the lengths of the
prefixes that neighbouring rows share tell the longest shorter match with more
rows, and how far its interval reaches.
"""

from __future__ import annotations

import numpy as np

class Bits:
    """A bitmap with a rank directory: ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        data = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        data[: len(packed)] = packed
        self.words = data.view("<u8")
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], ones[:-1]]).astype(np.uint32)
        self.ones = int(ones[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        w = at >> 6
        low = self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)


class WaveletMatrix:
    """rank of any symbol in any prefix, one bitmap a binary digit."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.levels, s = [], symbols
        for d in reversed(range(digits)):
            bit = (s >> d) & 1 == 1
            self.levels.append((d, Bits(bit), int(len(bit) - np.count_nonzero(bit))))
            s = np.concatenate([s[~bit], s[bit]])
        # where each symbol's run starts after the last level
        values, first = np.unique(s, return_index=True)
        self.first = np.zeros(1 << digits, np.int64)
        self.first[values] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``at`` symbols, elementwise."""
        for d, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> d) & 1 == 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    step = np.concatenate([[0], (sorted_keys[1:] != sorted_keys[:-1]).astype(np.int64)])
    ranks = np.cumsum(step)
    out = np.empty(len(keys), np.int64)
    out[order] = ranks
    return out, int(ranks[-1]) + 1


class FMIndex:
    """Index of ``pieces``: arrays of symbols over 1..size-1, for matches of up to
    ``longest`` symbols."""

    def __init__(self, pieces: list[np.ndarray], size: int, longest: int = 63):
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int(lengths.sum()) + len(pieces) + 1, np.int64)
        text[np.repeat(self.starts, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.concatenate(pieces)
        self.lengths, self.rows, self.longest, n = lengths, len(text), longest, len(text)
        depth = 1 << longest.bit_length()

        rank, k = _dense(text)
        ranks = [(1, rank)]  # classes of suffixes by their first 1, 2, 4, ... symbols
        while ranks[-1][0] < depth:
            h = ranks[-1][0]
            if k < n:
                after = np.zeros(n, np.int64)
                after[:-h] = rank[h:] + 1
                rank, k = _dense(rank * (k + 1) + after)
            ranks.append((2 * h, rank))
        self.order = np.argsort(rank, kind="stable")
        self.lcp = self._shared(ranks, depth)
        bwt = text[self.order - 1]
        self.size = size
        self.matrix = WaveletMatrix(bwt, max(1, int(size - 1).bit_length()))
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.text = text
        #: Matches that had to give up their last symbols.
        self.restarts = 0

    def _shared(self, ranks: list[tuple[int, np.ndarray]], depth: int) -> list[np.ndarray]:
        """Minima over 1, 2, 4, ... entries of the number of symbols, up to ``depth``,
        that each row shares with the one before; none at both ends."""
        i, j, n = self.order[:-1], self.order[1:], self.rows
        common = np.zeros(n - 1, np.int64)
        for h, r in reversed(ranks):
            a, b = i + common, j + common
            inside = (a < n) & (b < n) & (common + h <= depth)
            common[inside] += h * (r[a[inside]] == r[b[inside]])
        out = [np.concatenate([[0], common, [0]]).astype(np.uint8 if depth < 256 else np.int64)]
        while 2 * (w := 1 << (len(out) - 1)) <= n + 1:
            out.append(np.minimum(out[-1][:-w], out[-1][w:]))
        return out

    def widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all rows that share their first ``length`` symbols with lo..hi."""
        lo, hi = lo.copy(), hi.copy()
        for k in reversed(range(len(self.lcp))):
            w, least = 1 << k, self.lcp[k]
            at = np.maximum(lo - w + 1, 0)
            lo -= w * ((lo - w + 1 >= 0) & (least[at] >= length))
            at = np.minimum(hi, len(least) - 1)
            hi += w * ((hi < len(least)) & (least[at] >= length))
        whole = length == 0
        return np.where(whole, 0, lo), np.where(whole, self.rows, hi)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows that start with symbol + what lo..hi starts with."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.count[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows grouped by their first ``length`` symbols: the class of each row, and
        the bounds of the classes."""
        if not 0 < length <= self.longest:
            raise ValueError(f"this index holds matches of 1 to {self.longest} symbols, not {length}")
        new = self.lcp[0][: self.rows] < length
        return np.cumsum(new) - 1, np.append(np.flatnonzero(new), self.rows)

    def statistics(self, patterns: list[np.ndarray], most: int):
        """Matching statistics of streamed patterns, all at once, from their ends
        to their starts, cut at ``most`` symbols.

        Yields (pattern numbers, place in each, length of the longest match that
        starts there, its first row). A match of more than ``most`` symbols keeps
        its first ``most``; one that can't be extended gives up its last symbols.
        """
        of, bounds = self.classes(most)
        n = len(patterns)
        size = np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate(patterns) if n else np.zeros(0, np.int64)
        first = np.cumsum(size) - size
        who = np.argsort(-size, kind="stable")
        lo, hi, length = np.zeros(n, np.int64), np.full(n, self.rows, np.int64), np.zeros(n, np.int64)
        for back in range(1, int(size.max(initial=0)) + 1):
            live = who[: int(np.searchsorted(-size[who], -back, side="right"))]
            place = size[live] - back
            symbol, l, h, m = flat[first[live] + place], lo[live], hi[live], length[live]
            a, b = self.step(symbol, l, h)
            stuck = np.flatnonzero((a >= b) & (m > 0))
            while len(stuck):
                self.restarts += len(stuck)
                m[stuck] = np.maximum(self.lcp[0][l[stuck]], self.lcp[0][h[stuck]])
                l[stuck], h[stuck] = self.widen(l[stuck], h[stuck], m[stuck])
                a[stuck], b[stuck] = self.step(symbol[stuck], l[stuck], h[stuck])
                stuck = stuck[(a[stuck] >= b[stuck]) & (m[stuck] > 0)]
            none = a >= b
            a[none], b[none] = 0, self.rows
            matched = np.where(none, 0, m + 1)
            cut = matched > most
            of_cut = of[a[cut]]
            a[cut], b[cut], matched[cut] = bounds[of_cut], bounds[of_cut + 1], most
            lo[live], hi[live], length[live] = a, b, matched
            yield live, place, matched, a
