"""How many sets of k segments keep within a total length, and each of them by its number.

Only the lengths matter for what fits, so a table over lengths (how many ways there are to take j more segments from the
lengths that follow within b) tells the number of sets, and turns a number below it into one set and back: taking a segments
of a length leaves so many ways, and the number falls into the range of one a. Different numbers are different sets, so
draws are numbers that a permutation deals out; nothing is rejected, and asking for all gives all.

The table is as large as k times the cap and is made anew where it is needed, a block of lengths at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np

#: Numbers of sets below this are counted exactly in 64 bits; beyond it in doubles, right to 12 digits.
EXACT = 1 << 62
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit numbers spread by a key."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(key % (1 << 64))) * np.uint64(_ODD[0])
        h = (h ^ (h >> np.uint64(30))) * np.uint64(_ODD[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(_ODD[2])
    return h ^ (h >> np.uint64(31))


def dealt(numbers: np.ndarray, of: int, seed: int) -> np.ndarray:
    """Numbers below ``of`` permuted among themselves: four rounds over halves of the bits, repeated while the outcome is too large."""
    half = max(1, -(-(of - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            left, right = right, left ^ (mixed(right, seed * 8 + r + 1) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(of)]
    return out.astype(np.int64)


def nth_combination(number: int, a: int) -> list[int]:
    """The ``number``-th (from 0) set of a whole numbers from 0 on, in order of the largest."""
    out = []
    for size in range(a, 0, -1):
        lo, hi = size - 1, size
        while comb(hi, size) <= number:
            lo, hi = hi, 2 * hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if comb(mid, size) <= number else (lo, mid)
        out.append(lo)
        number -= comb(lo, size)
    return out


class SetCounts:
    """``lengths``: (length, how many segments have it), for sets of k with totals up to ``cap``. Without a cap all lengths are 0."""

    def __init__(self, lengths: list[tuple[int, int]], k: int, cap: int):
        self.lengths = sorted((n, c) for n, c in lengths if n <= cap and c > 0)
        self.k, self.cap, self.exact = k, cap, False
        self.every = max(1, isqrt(len(self.lengths)))
        most, kept = self._layers()
        if most < EXACT:
            self.exact = True
            _, kept = self._layers()
        self.kept = kept
        #: The number of sets.
        self.total = (int if self.exact else float)(kept[0][k, cap])

    def _back(self, after: np.ndarray, n: int, c: int) -> np.ndarray:
        """The table that a length's segments may be taken from, of that of the lengths that follow."""
        out = after.copy()
        for a in range(1, min(self.k, c, self.cap // n if n else self.k) + 1):
            ways = comb(c, a)
            if not self.exact or ways < EXACT:  # else nothing is left for them to be taken with
                out[a:, a * n :] += (ways if self.exact else float(ways)) * after[: self.k + 1 - a, : self.cap + 1 - a * n]
        return out

    def _start(self) -> np.ndarray:
        end = np.zeros((self.k + 1, self.cap + 1), np.int64 if self.exact else np.float64)
        end[0] = 1
        return end

    def _layers(self) -> tuple[float, dict[int, np.ndarray]]:
        """The largest number that occurs, and every so manieth table."""
        table, kept, most = self._start(), {}, 1.0
        kept[len(self.lengths)] = table
        for i in reversed(range(len(self.lengths))):
            table = self._back(table, *self.lengths[i])
            if i % self.every == 0:
                kept[i] = table
            most = max(most, float(table.max()))
        return most, kept

    def _forward(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Of each length in order: itself, how many segments have it, the table of the lengths that follow."""
        n = len(self.lengths)
        for a in range(0, n, self.every):
            b = min(a + self.every, n)
            tables = [self.kept[b]]
            for i in reversed(range(a + 1, b)):
                tables.append(self._back(tables[-1], *self.lengths[i]))
            for i in range(a, b):
                yield *self.lengths[i], tables[b - 1 - i]

    def sets(self, numbers: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Length and place among the segments of that length of the k members of each set, by the set's number. Where numbers
        are doubles a set's number only seeds its draw."""
        d = len(numbers)
        length, place = np.zeros((d, self.k), np.int64), np.zeros((d, self.k), np.int64)
        j, b, r = np.full(d, self.k), np.full(d, self.cap), numbers.astype(np.int64 if self.exact else np.float64)
        for layer, (n, c, after) in enumerate(self._forward()):
            on = np.flatnonzero(j > 0)
            if not len(on):
                break
            if not self.exact:
                u = mixed(numbers[on], seed * 1_000_003 + layer + 1).astype(np.float64) / 2.0**64
                stay = np.zeros(len(on))
                for a in range(min(self.k, c) + 1):
                    fits = (j[on] >= a) & (b[on] >= a * n)
                    stay[fits] += float(comb(c, a)) * after[j[on][fits] - a, b[on][fits] - a * n]
                r[on] = u * stay
            left = r[on]
            took = np.full(len(on), -1)
            for a in range(min(self.k, c) + 1):
                fits = (took < 0) & (j[on] >= a) & (b[on] >= a * n)
                ways = np.zeros(len(on), after.dtype)
                ways[fits] = after[j[on][fits] - a, b[on][fits] - a * n]
                if self.exact and comb(c, a) >= EXACT:
                    continue
                ways = ways * (comb(c, a) if self.exact else float(comb(c, a)))
                here = fits & (left < ways)
                took[here] = a
                left = np.where((took < 0) & fits, left - ways, left)
            if not self.exact:  # the last that is possible, where rounding left nothing
                for at in np.flatnonzero(took < 0).tolist():
                    a = next(a for a in reversed(range(min(self.k, c) + 1)) if j[on[at]] >= a and b[on[at]] >= a * n and after[j[on[at]] - a, b[on[at]] - a * n] > 0)
                    took[at], left[at] = a, 0
            r[on] = left
            for at in np.flatnonzero(took > 0).tolist():
                i, a = int(on[at]), int(took[at])
                rest = after[j[i] - a, b[i] - a * n].item()
                number = int(r[i] // rest)
                if self.exact:
                    r[i] -= number * rest
                members = nth_combination(min(number, comb(c, a) - 1), a)
                first = self.k - int(j[i])
                length[i, first : first + a], place[i, first : first + a] = n, members
                j[i] -= a
                b[i] -= a * n
        return length, place


class SequenceCounts:
    """The same for sequences of k in which a segment may come again: of segments by their lengths, few of them."""

    def __init__(self, lengths: list[int], k: int, cap: int):
        self.lengths, self.k, self.cap = lengths, k, cap
        self.tables = [[1] * (cap + 1)]
        for _ in range(k):
            last = self.tables[-1]
            self.tables.append([sum(last[b - n] for n in lengths if n <= b) for b in range(cap + 1)])
        self.total = self.tables[k][cap]

    def sequence(self, number: int) -> list[int]:
        """Places of the segments in the sequence of this number."""
        out, b = [], self.cap
        for j in reversed(range(self.k)):
            for i, n in enumerate(self.lengths):
                ways = self.tables[j][b - n] if n <= b else 0
                if number < ways:
                    out.append(i)
                    b -= n
                    break
                number -= ways
        return out
