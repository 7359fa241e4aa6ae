"""Counts and medians over all pairs of one series in n log n steps.

Order relations of pairs are counted by bits of ranks: elements that agree in all higher bits form a group in
their original order, and within it every element with a set bit stands in one relation to all elements without
it.  One stable partition per bit, all groups at once.

The median of all pairwise slopes is selected without listing them: a slope is at most m exactly if ``y - m t`` does
not rise between the two points, so slopes at or below a value are counted as above.  A random sample brackets the
middle, counting confirms the bracket, and once few slopes remain inside they are listed by the same partitions.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = 1_000_000  # slopes that are sorted at once
SAMPLE = 400_000  # pairs drawn to bracket the middle


def _levels(rank: np.ndarray):
    """Per bit of the ranks, highest first: elements in group order, their bit, and where their group begins."""
    n = len(rank)
    order = np.arange(n)
    start = np.zeros(n, np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank[order] >> bit & 1).astype(np.int64)
        yield order, one, start
        # Elements without the bit go to the front of their group, the others behind them, in the same order.
        ones = np.cumsum(one) - one
        ones_here = ones - ones[start]
        at = np.arange(n)
        zeros_here = at - start - ones_here
        last = np.append(np.nonzero(np.diff(start))[0], n - 1)
        zeros = np.zeros(n, np.int64)
        zeros[start[last]] = zeros_here[last] + 1 - one[last]
        zeros = zeros[start]
        goes = start + np.where(one == 1, zeros + ones_here, zeros_here)
        moved, begin = np.empty_like(order), np.empty_like(start)
        moved[goes] = order
        begin[goes] = start + one * zeros
        order, start = moved, begin


def relations(values: np.ndarray) -> tuple[int, int]:
    """How many pairs rise and how many fall from the earlier to the later element; equal ones do neither."""
    if len(values) < 2:
        return 0, 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    rising = falling = 0
    for _, one, start in _levels(rank):
        ones = np.cumsum(one) - one
        ones = ones - ones[start]
        zeros = np.arange(len(rank)) - start - ones
        rising += int(zeros[one == 1].sum())
        falling += int(ones[one == 0].sum())
    return rising, falling


def falling_pairs(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of which the later has the smaller rank."""
    first, second = [], []
    for order, one, start in _levels(rank):
        ones_before = np.cumsum(one) - one
        count = np.where(one == 0, ones_before - ones_before[start], 0)
        later = np.nonzero(count)[0]
        if not len(later):
            continue
        # The set bits of a group in order: a run of the list of all set bits.
        set_bits = order[np.nonzero(one)[0]]
        reps = count[later]
        offsets = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        first.append(set_bits[np.repeat(ones_before[start[later]], reps) + offsets])
        second.append(np.repeat(order[later], reps))
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def _slopes(y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (y[j] - y[i]) / (j - i)


def median_slope(y: np.ndarray, limit: int = LISTED, sample: int = SAMPLE) -> float | None:
    """Median of ``(y[j] - y[i]) / (j - i)`` over all pairs, the mean of the middle two for an even number."""
    n = len(y)
    total = n * (n - 1) // 2
    if not total:
        return None
    y = np.asarray(y, float)
    low_rank, high_rank = (total - 1) // 2, total // 2
    if total <= limit:
        i, j = np.triu_indices(n, 1)
        s = np.partition(_slopes(y, i, j), (low_rank, high_rank))
        return float((s[low_rank] + s[high_rank]) / 2)
    t = np.arange(n)
    rng = np.random.default_rng(n)
    steps = np.diff(y)
    # Every slope is an average of steps, so these enclose all of them.
    lo, hi, below, upto = np.nextafter(steps.min(), -np.inf), steps.max(), 0, total

    def at_most(m: float) -> int:
        return total - relations(y - m * t)[0]

    while upto - below > limit:
        i, j = rng.integers(0, n, (2, sample))
        s = _slopes(y, np.minimum(i, j)[i != j], np.maximum(i, j)[i != j])
        s = np.sort(s[(s > lo) & (s <= hi)])
        if len(s) < 50 or s[0] == s[-1]:
            # Too few of the sample lie inside, or they are all equal: halve, down to neighbouring numbers.
            cuts = [lo + (hi - lo) / 2]
            if s.size and s[0] == s[-1]:
                cuts = [float(np.nextafter(s[0], -np.inf)), float(s[0])]
        else:
            middle = (low_rank - below) / (upto - below) * len(s)
            margin = 3 * np.sqrt(len(s))
            cuts = sorted({float(s[int(np.clip(middle + d, 0, len(s) - 1))]) for d in (-margin, margin)})
        before = lo, hi
        for cut in cuts:
            if not lo < cut < hi:
                continue
            c = at_most(cut)
            if c <= low_rank:
                lo, below = cut, c
            elif c > high_rank:
                hi, upto = cut, c
            else:
                # The middle two lie on either side of the cut.
                return float((_edge(y, t, lo, cut, below, c, c - 1, limit) + _edge(y, t, cut, hi, c, upto, c, limit)) / 2)
        if (lo, hi) == before or hi <= np.nextafter(lo, np.inf):
            return float(hi)
    return float((_edge(y, t, lo, hi, below, upto, low_rank, limit) + _edge(y, t, lo, hi, below, upto, high_rank, limit)) / 2)


def _edge(y: np.ndarray, t: np.ndarray, lo: float, hi: float, below: int, upto: int, rank: int, limit: int) -> float:
    """The slope of a rank (from 0) that lies in ``(lo, hi]``, of which ``below`` and ``upto`` slopes reach the ends."""
    n, total = len(y), len(y) * (len(y) - 1) // 2
    while upto - below > limit:
        mid = lo + (hi - lo) / 2
        if not lo < mid < hi:
            return hi
        c = total - relations(y - mid * t)[0]
        if c <= rank:
            lo, below = mid, c
        else:
            hi, upto = mid, c
    # Slopes in between belong to pairs that change places between the two orders.
    orders = [np.lexsort((-t, y - m * t)) for m in (lo, hi)]
    place = np.empty(n, np.int64)
    place[orders[1]] = np.arange(n)
    first, second = falling_pairs(place[orders[0]])
    i, j = orders[0][first], orders[0][second]
    s = np.sort(_slopes(y, i[i < j], j[i < j]))
    return float(s[min(max(rank - below, 0), len(s) - 1)]) if len(s) else hi
