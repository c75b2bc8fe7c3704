"""Ratios of matching blocks of two texts, as difflib tells them, with bounds that end the search for those that are too low."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np

#: Pairs of equal letters that are looked through as arrays; beyond these, difflib goes through the letters one by one.
POINTS = 1 << 22


def _letters(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters of both as small numbers, the same for equal ones."""
    if a.isascii() and b.isascii():
        return np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    both = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    numbers = np.unique(both, return_inverse=True)[1]
    return numbers[: len(a)], numbers[len(a) :]


def _finder(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> Callable[[int, int, int, int], tuple[int, int, int]]:
    """The first of the longest runs of equal letters within bounds, of letters that `of` has: (start in x, start in y, length)."""
    ours = np.flatnonzero(of[y])
    ours = ours[np.argsort(y[ours], kind="stable")].astype(np.int32)
    first = np.searchsorted(y[ours], np.arange(len(of)))
    met = np.bincount(y[ours], minlength=len(of))
    at = np.flatnonzero(of[x])
    n = met[x[at]]
    i = np.repeat(at, n).astype(np.int32)
    j = ours[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[x[at]], n)]
    run = np.ones(len(i), np.int32)  # of the run that ends at a point
    on = np.arange(len(i))
    for back in range(1, min(len(x), len(y))):
        p, q = i[on] - back, j[on] - back
        before = x[p]  # from the end where p is below 0
        on = on[(p >= 0) & (q >= 0) & (before == y[q]) & of[before]]
        if not len(on):
            break
        run[on] += 1

    def find(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        lo, hi = np.searchsorted(i, (alo, ahi))
        p, q = i[lo:hi], j[lo:hi]
        k = np.minimum(np.minimum(run[lo:hi], p - (alo - 1)), q - (blo - 1))
        k[q >= bhi] = 0
        best = int(k.argmax()) if len(k) else 0
        size = int(k[best]) if len(k) else 0
        return (int(p[best]) - size + 1, int(q[best]) - size + 1, size) if size > 0 else (alo, blo, 0)

    return find


def _ahead(a: str, b: str, i: int, j: int, most: int) -> int:
    """Equal letters from i and j on."""
    n = 0
    while n < most and a[i + n : i + min(n + 64, most)] == b[j + n : j + min(n + 64, most)]:
        n = min(n + 64, most)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def _back(a: str, b: str, i: int, j: int, most: int) -> int:
    """Equal letters before i and j."""
    n = 0
    while n < most and a[i - min(n + 64, most) : i - n] == b[j - min(n + 64, most) : j - n]:
        n = min(n + 64, most)
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def ratio(a: str, b: str, least: float) -> float:
    """SequenceMatcher(None, a, b).ratio(), or 0 where that is below `least`, which shows as soon as the letters that are
    matched and those that still may be are too few.

    A block is looked for as difflib does: by the longest run of letters that are not frequent in b, the first of these,
    which then grows by any equal letters. Places of such letters are found once for the pair, and a block within bounds
    is the first of the largest of an array."""
    every = len(a) + len(b)
    if not every:
        return 1.0
    enough = lambda matched: 2.0 * matched / every > least - 1e-6
    if not enough(min(len(a), len(b))):
        return 0.0
    x, y = _letters(a, b)
    letters = int(max(x.max(initial=0), y.max(initial=0))) + 1
    in_a, in_b = np.bincount(x, minlength=letters), np.bincount(y, minlength=letters)
    if not enough(int(np.minimum(in_a, in_b).sum())):
        return 0.0
    of = (in_b > 0) & (in_b <= (len(b) // 100 + 1 if len(b) >= 200 else len(b)))
    if int((in_a[of].astype(np.int64) * in_b[of]).sum()) <= POINTS:
        find = _finder(x, y, of)
        grown = False
    else:
        find, grown = SequenceMatcher(None, a, b).find_longest_match, True
    matched, open_, left = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        open_ -= min(ahi - alo, bhi - blo)
        i, j, k = find(alo, ahi, blo, bhi)
        if not grown:
            n = _back(a, b, i, j, min(i - alo, j - blo))
            i, j, k = i - n, j - n, k + n
            k += _ahead(a, b, i + k, j + k, min(ahi - i - k, bhi - j - k))
        if k:
            matched += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    left.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if not enough(matched + open_):
            return 0.0
    return 2.0 * matched / every
