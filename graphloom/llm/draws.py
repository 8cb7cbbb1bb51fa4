"""Exact draws without replacement from populations of any size."""

from __future__ import annotations

import math

import numpy as np

#: numpy draws from fewer than this.
_LARGE = 10**9


def _log_growth(a: int, d: int) -> float:
    """ln((a + d)! / a!) - d ln(a + 1), without the loss of digits of two large logarithms."""
    if min(a, a + d) < 10_000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1) - d * math.log(a + 1)
    return (a + d + 0.5) * math.log1p(d / a) - d - d * math.log1p(1 / a) + (1 / (a + d) - 1 / a) / 12


def log_ratio(good: int, bad: int, left: int, mode: int, x: int) -> float:
    """ln of how many times as likely x good ones are as mode good ones among left drawn."""
    d = x - mode
    up, down = (good - mode + 1) * (left - mode + 1), (mode + 1) * (bad - left + mode + 1)
    return d * math.log1p((up - down) / down) - _log_growth(mode, d) - _log_growth(good - mode, -d) - _log_growth(left - mode, -d) - _log_growth(bad - left + mode, d)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, left: int) -> int:
    """How many good ones are among left that are drawn from good + bad, none twice. Python's integers have no limit, and so this
    has none: one by one where few decide, by ratio of uniforms elsewhere."""
    total = good + bad
    if 2 * left > total:
        return good - hypergeometric(rng, good, bad, total - left)
    if good > bad:
        return left - hypergeometric(rng, bad, good, left)
    if left > good:
        good, left, bad = left, good, total - left
    if left <= 32:
        got = 0
        for i in range(left):
            got += int(rng.integers(total - i)) < good - got
        return got
    mean, spread = left * good / total, math.sqrt(left * (total - left) * good * bad / (total * total * (total - 1)) + 0.5)
    mode = (left + 1) * (good + 1) // (total + 2)
    # The width of a table that holds all (u, v) with u * u below the ratio at v / u.
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if 0 <= x <= left and 2 * math.log(u) <= log_ratio(good, bad, left, mode, x):
            return x


def draw_counts(counts: np.ndarray, left: int, seed: list[int]) -> np.ndarray:
    """How many of each kind are among `left` drawn from all of counts, none twice: halves of the kinds first, where they are many."""
    rng, out, todo = np.random.default_rng(seed), np.zeros(len(counts), np.int64), [(0, len(counts), left)]
    while todo:
        a, b, k = todo.pop()
        if b - a == 1:
            out[a] = k
        elif (total := int(counts[a:b].sum())) < _LARGE:
            out[a:b] = rng.multivariate_hypergeometric(counts[a:b], k, method="marginals") if total else 0
        else:
            half = (a + b) // 2
            low = int(counts[a:half].sum())
            got = hypergeometric(rng, low, total - low, k)
            todo += [(a, half, got), (half, b, k - got)]
    return out
