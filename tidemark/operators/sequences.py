"""Longest common subsequences of two sequences, exact and in memory linear in their lengths.

Few differences are found by furthest-reaching paths; many by sets of bits, a row of the table of lengths at a time. Both give
sequences of the greatest length, so counts of what came and went are minimal whichever was taken.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np

#: Differences up to which paths are followed; they keep this squared / 2 numbers.
PATHS = 512
#: Bytes of the bit sets that are kept for elements met again.
MASK_BYTES = 64 << 20


def numbered(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[list[int], list[int]]:
    ids: dict[Hashable, int] = {}
    return [ids.setdefault(x, len(ids)) for x in a], [ids.setdefault(x, len(ids)) for x in b]


def paths(a: list[int], b: list[int], most: int) -> list[tuple[int, int]] | None:
    """Matches (place in a, place in b) of a longest common subsequence, in order; None if over `most` elements differ."""
    n, m = len(a), len(b)
    reach = {1: 0}  # of each diagonal (place in a - place in b): how far in a
    history = []
    for d in range(min(most, n + m) + 1):
        history.append(dict(reach) if d else {})
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _back(history, n, m)
    return None


def _back(history: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    found = []
    for d in range(len(history) - 1, 0, -1):
        before, k = history[d], x - y
        came = k + 1 if k == -d or (k != d and before[k - 1] < before[k + 1]) else k - 1
        start = before[came] if came == k + 1 else before[came] + 1  # where the equal stretch of this step begins
        found += [(i, i - k) for i in range(x - 1, start - 1, -1)]
        x, y = before[came], before[came] - came
    found += [(i, i) for i in range(x - 1, -1, -1)]
    return found[::-1]


class Bits:
    """Bit sets of where each element stands in a sequence."""

    def __init__(self, a: list[int]) -> None:
        self.size = len(a)
        self.places: dict[int, list[int]] = {}
        for i, x in enumerate(a):
            self.places.setdefault(x, []).append(i)
        self.kept: dict[int, int] = {}
        self.room = MASK_BYTES // (self.size // 8 + 32)

    def of(self, x: int) -> int:
        mask = self.kept.get(x)
        if mask is None:
            buffer = bytearray(self.size // 8 + 1)
            for i in self.places.get(x, ()):
                buffer[i >> 3] |= 1 << (i & 7)
            mask = int.from_bytes(buffer, "little")
            if len(self.kept) < self.room:
                self.kept[x] = mask
        return mask

    def row(self, b: list[int]) -> int:
        """Bit i is 0 where the common subsequence of a[:i + 1] and b is one longer than that of a[:i] and b."""
        full = (1 << self.size) - 1
        v = full
        for x in b:
            if x in self.places:
                u = v & self.of(x)
                v = ((v + u) | (v - u)) & full
        return v


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of b and each prefix of a, the empty one first."""
    row = Bits(a).row(b)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _halves(a: list[int], b: list[int], x: int, y: int) -> Iterator[tuple[int, int]]:
    """Matches by halving b; x and y are where a and b begin. Halves wait on a stack, the first one on top."""
    waiting = [(a, b, x, y)]
    while waiting:
        a, b, x, y = waiting.pop()
        if not a or not b:
            continue
        if len(b) == 1:
            if b[0] in a:
                yield x + a.index(b[0]), y
            continue
        found = paths(a, b, min(PATHS, 2 * (len(a) + len(b)) // 64 + 4))
        if found is not None:
            yield from ((x + i, y + j) for i, j in found)
            continue
        half = len(b) // 2
        cut = int(np.argmax(lengths(a, b[:half]) + lengths(a[::-1], b[half:][::-1])[::-1]))
        waiting.append((a[cut:], b[half:], x + cut, y + half))
        waiting.append((a[:cut], b[:half], x, y))


def matches(a: Sequence[Hashable], b: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
    """(place in a, place in b) of a longest common subsequence, in order. Nothing is worked out before it is asked for."""
    a, b = numbered(a, b)
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        yield start, start
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    yield from _inner(a, b, start, end_a, end_b)
    yield from ((end_a + i, end_b + i) for i in range(len(a) - end_a))


def _inner(a: list[int], b: list[int], start: int, end_a: int, end_b: int) -> Iterator[tuple[int, int]]:
    """Matches between the equal beginnings and ends; what only one side has can't match and is left out."""
    common = set(a[start:end_a]) & set(b[start:end_b])
    at_a = [i for i in range(start, end_a) if a[i] in common]
    at_b = [j for j in range(start, end_b) if b[j] in common]
    x, y = [a[i] for i in at_a], [b[j] for j in at_b]
    found = paths(x, y, PATHS)
    for i, j in found if found is not None else _halves(x, y, 0, 0):
        yield at_a[i], at_b[j]
