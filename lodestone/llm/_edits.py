"""Edit distances of many pairs of strings at once, by the places that so many edits reach on the diagonals of their matrix."""

from __future__ import annotations

import numpy as np

#: Blocks of 64 diagonals up to which pairs are done together, and places of a table of them.
WIDE, TABLES = 20, 1 << 16
#: Kinds of runs of three symbols that are counted together, and symbols of a string for one of them, at most.
RUNS, FULL = 1 << 18, 3
#: Symbols that a diagonal may lie behind the furthest one of its pair, where one way of few edits is looked for and not the least.
BEHIND = 24
#: Edits from which on that way is given up where it hardly comes on.
TRIED = 6
_1 = np.uint64(1)


class _Strings:
    """Strings end to end, each with an end that equals nothing of the other side. words: at each place the symbols from there on that 64 bits hold; step: how many."""

    def __init__(self, s: list[str], t: list[str]):
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (s, t)]
        codes = np.frombuffer("\0".join([*s, *t, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        kinds = int(np.count_nonzero(seen)) + 2
        unit = np.dtype(np.uint8 if kinds <= 1 << 8 else np.uint16 if kinds <= 1 << 16 else np.uint32)
        self.step = 8 // unit.itemsize
        self._shift = np.uint8((8 * unit.itemsize).bit_length() - 1)
        ends = np.cumsum(np.concatenate(self.sizes) + 1)
        self.starts = np.split(ends - np.concatenate(self.sizes) - 1, [len(s)])
        flat = np.zeros(len(codes) + self.step, unit)
        flat[: len(codes)] = (np.cumsum(seen) + 1).astype(unit)[codes]
        flat[ends[: len(s)] - 1], flat[ends[len(s) :] - 1] = 0, 1
        self._last = len(codes) - 1
        self.words = np.ndarray(len(codes), "<u8", flat, strides=(unit.itemsize,)).copy()
        x = flat.astype(np.uint32)
        self._runs = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(14)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i and places j on are equal."""
        x = self.words[i]
        x ^= self.words[j]
        on = np.flatnonzero(x == 0)
        out = self._equal(x)
        out[on] = self.step
        wide = 4
        while len(on):
            # some words at a time; those past the ends lie behind an end, where the strings differ
            at = out[on][:, None] + np.arange(0, wide * self.step, self.step)
            x = self.words[np.minimum(i[on][:, None] + at, self._last)]
            x ^= self.words[np.minimum(j[on][:, None] + at, self._last)]
            apart = x != 0
            first = apart.argmax(1)
            rows = np.arange(len(on))
            whole = ~apart[rows, first]
            out[on] += np.where(whole, wide * self.step, first * self.step + self._equal(x[rows, first]))
            on = on[whole]
            wide = min(64, wide * 4)
        return out

    def _equal(self, x: np.ndarray) -> np.ndarray:
        """How many symbols of two words are equal up to the first that are not, given their bits that differ."""
        return (np.bitwise_count(x ^ (x - _1)) - np.uint8(1) >> self._shift).astype(np.int64)

    def _counts(self, start: np.ndarray, size: np.ndarray, kinds: int) -> np.ndarray:
        size = np.maximum(size - 2, 0)
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount((self._runs[at] & np.uint32(kinds - 1)) + np.repeat(np.arange(len(start)) * kinds, size), minlength=len(start) * kinds).reshape(-1, kinds)

    def far(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the runs of three symbols show that strings are more than so many edits apart, as each edit makes and breaks three at most. n falls from pair to pair or stays."""
        out, k = np.zeros(len(a), bool), 0
        while k < len(a):
            kinds = min(RUNS, 1 << max(8, (int(n[k]) // FULL - 1).bit_length() + 2))
            c = slice(k, k + RUNS // kinds)
            apart = self._counts(a[c], m[c], kinds) - self._counts(b[c], n[c], kinds)
            more = np.maximum(apart, 0).sum(1)
            out[c] = np.maximum(more, more - apart.sum(1)) > 3 * most[c]
            k = c.stop
        return out


def _together(strings: _Strings, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray, behind: int | None) -> np.ndarray:
    """Whether strings of m symbols at places a and longer ones of n at b are at most so many edits apart.

    Of each diagonal of a pair's matrix the furthest row that e edits reach is kept, for e = 0, 1, ...: one more than a neighbour's, or its own, and on along
    equal symbols. Diagonals from which `most` edits can't come to the matrix's end are left out. With behind, those too that lie so much behind: then
    what is found is within `most`, but not all is found.
    """
    out, own, over = np.zeros(len(a), bool), np.arange(len(a)), np.zeros(len(a), bool)
    more = n - m
    low, high = int(((most - more) // 2).max()), int(((most + more) // 2).max())
    diagonals = np.arange(-low, high + 1)
    # a column at either side that nothing reaches
    reach = np.full((len(a), low + high + 3), -(1 << 40))
    reach[:, low + 1] = strings.alike(a, b)
    e, start, stop = 0, -low, high
    while True:
        met = ~over & (reach[np.arange(len(own)), more + low + 1] >= m)
        out[own[met]] = True
        over |= met | (most <= e)
        if over.sum() * 5 >= len(over):
            own, a, b, m, n, most, more, reach, over = (x[~over] for x in (own, a, b, m, n, most, more, reach, over))
            if not len(own):
                return out
        e += 1
        # columns that so few edits reach, and from which the rest of them come to the end
        first = max(start, -e, int((more - most).min()) + e)
        last = min(stop, e, int((more + most).max()) - e)
        if first > last:
            return out
        left, right = first + low + 1, last + low + 2
        d = diagonals[left - 1 : right - 1]
        row = np.maximum(reach[:, left:right], reach[:, left + 1 : right + 1])
        row += 1
        np.maximum(row, reach[:, left - 1 : right - 1], out=row)
        np.minimum(row, np.minimum(m[:, None], n[:, None] - d), out=row)
        if behind is not None:
            along = 2 * row + d
            most_along = along.max(1)
            row[along < most_along[:, None] - 2 * behind] = -(1 << 40)
            if e >= TRIED:
                # of no use where it comes half as far as it should
                row[most_along * most < (m + n) * e // 2] = -(1 << 40)
        at, col = np.nonzero(row >= np.maximum(0, -d))
        i = row[at, col]
        x = a[at] + i
        row[at, col] = i + strings.alike(x, x + (b - a)[at] + d[col])
        reach[:, left:right] = row
        if behind is not None:
            if not len(col):
                return out
            reach[:, left - 1] = reach[:, right] = -(1 << 40)
            start, stop = max(-low, first + int(col.min()) - 1), min(high, first + int(col.max()) + 1)


def within(s: list[str], t: list[str], share: float, sieve: bool = True) -> np.ndarray:
    """Whether each pair's edit distance is at most that share of the longer string's characters, rounded down. sieve: whether pairs that are far apart are looked for first."""
    out = np.zeros(len(s), bool)
    if not len(s):
        return out
    strings = _Strings(s, t)
    swap = strings.sizes[0] > strings.sizes[1]
    m, n = np.minimum(*strings.sizes), np.maximum(*strings.sizes)
    a, b = (np.where(swap, x, y) for x, y in (strings.starts[::-1], strings.starts))
    most = (n * share + 1e-9).astype(np.int64)
    left = np.flatnonzero(n - m <= most)
    left = left[np.argsort(-n[left], kind="stable")]
    if sieve:
        left = left[~strings.far(a[left], b[left], m[left], n[left], most[left])]
    for behind in (BEHIND, None):
        k = 0
        while k < len(left):
            # the first has the most diagonals
            wide = int(most[left[k]]) + 1
            now = left[k : k + (max(1, TABLES // wide) if wide <= 64 * WIDE else 1)]
            out[now] = _together(strings, a[now], b[now], m[now], n[now], most[now], behind)
            k += len(now)
        left = left[~out[left]]
    return out
