"""Seeded random draws: hypergeometric matrices and index permutations."""

from __future__ import annotations

import numpy as np

#: numpy draws hypergeometric counts below this total.
EXACT_TOTAL = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Good ones among ``taken`` of ``good + bad``, drawn exactly at any size.

    Beyond numpy's range the items are ordered at random by a point on the unit interval:
    the point where a fair half begins cuts good, bad and taken.  How many of the good and of
    the bad lie below it are binomial draws; if those are fewer than ``taken`` all of them are
    taken and the rest comes from above, otherwise the draw goes on below.
    """
    found = 0
    while taken:
        total = good + bad
        if total < EXACT_TOTAL:
            return found + int(rng.hypergeometric(good, bad, taken))
        share = min(max(taken / total, 2.0**-40), 1 - 2.0**-40)
        below_good, below_bad = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
        below = below_good + below_bad
        if below <= taken:
            found += below_good
            good, bad, taken = good - below_good, bad - below_bad, taken - below
        else:
            # What isn't taken of those below is as random a choice as what is.
            found += below_good
            good, bad, surplus = below_good, below_bad, below - taken
            return found - hypergeometric(rng, good, bad, surplus)
    return found


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Random counts with these row and column sums, distributed as under a uniform shuffle.

    Entry (p, s) is how many of the items of p go to s.  Row after row, the counts are
    multivariate hypergeometric draws from what the columns still hold.
    """
    rng = np.random.default_rng(seed)
    left = [int(c) for c in columns]
    matrix = np.zeros((len(rows), len(columns)), np.int64)
    for p, need in enumerate(rows):
        need, total = int(need), sum(left)
        for s, has in enumerate(left):
            if not need:
                break
            drawn = hypergeometric(rng, has, total - has, need)
            matrix[p, s] = drawn
            need -= drawn
            total -= has
            left[s] -= drawn
    return matrix


def _round(half: np.ndarray, key: np.ndarray, r: int) -> np.ndarray:
    h = half * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(r * 0x632BE59BD9B4E019 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of [0, size) for each key, applied to ``index``.

    A four-round Feistel network over the least even number of bits that holds ``size``;
    values outside the range walk on along their cycle until they fall into it.
    """
    value, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    bits = np.maximum(np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2), 1).astype(np.uint64)
    bits += (np.uint64(1) << (bits * np.uint64(2))) < size
    mask = (np.uint64(1) << bits) - np.uint64(1)
    todo = np.arange(len(value))
    while len(todo):
        b, m, k, v = bits[todo], mask[todo], key[todo], value[todo]
        left, right = v >> b, v & m
        for r in range(4):
            left, right = right, left ^ (_round(right, k, r) & m)
        value[todo] = (left << b) | right
        todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)
