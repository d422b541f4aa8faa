"""Statistics of alignments and of evolutionary distance as Column expressions or plain functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_score(raw: Column, lam: float, k: float) -> Column:
    return (raw * lam - math.log(k)) / math.log(2)


def raw_score(bits: Column, lam: float, k: float) -> Column:
    return (bits * math.log(2) + math.log(k)) / lam


def e_value(raw: Column, space: Column, lam: float, k: float) -> Column:
    return space * F.exp(raw * -lam + math.log(k))


def karlin_altschul_lambda(match: int, mismatch: int, p_match: float = 0.25) -> float:
    """Positive root of sum p_i * exp(lambda * s_i) = 1 for ungapped match and mismatch scores, by bisection."""
    f = lambda x: p_match * math.exp(x * match) + (1 - p_match) * math.exp(x * mismatch) - 1
    low, high = 1e-9, 1.0
    while f(high) < 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def karlin_altschul(match: int, mismatch: int, p_match: float = 0.25, steps: int = 400) -> tuple[float, float, float]:
    """(lambda, K, H) for ungapped match and mismatch scores whose mean is below zero (Karlin and Altschul, 1990).

    H is the mean information of a column of chance alignments of high score; K sums up, over the number of columns, how likely random
    scores are to be below zero, weighted, or not.
    """
    if p_match * match + (1 - p_match) * mismatch >= 0:
        raise ValueError("the mean score must be below zero")
    lam = karlin_altschul_lambda(match, mismatch, p_match)
    step = math.gcd(match, mismatch)
    high, low = match // step, mismatch // step
    one = np.zeros(high - low + 1)
    one[high - low], one[0] = p_match, 1 - p_match
    entropy = lam * (p_match * match * math.exp(lam * match) + (1 - p_match) * mismatch * math.exp(lam * mismatch))
    chances, sigma = np.ones(1), 0.0
    for k in range(1, steps + 1):
        chances = np.convolve(chances, one)
        score = np.arange(len(chances)) + k * low
        sigma += float((chances * np.exp(np.minimum(score, 0) * lam * step)).sum()) / k
        # The chance of a score of zero or more falls by a fixed factor, so the rest soon adds nothing.
        if chances[score >= 0].sum() < 1e-12 and (chances * np.exp(np.minimum(score, 0) * lam * step)).sum() < 1e-12:
            break
    return lam, step * lam * math.exp(-2 * sigma) / (entropy * (1 - math.exp(-lam * step))), entropy


def log_sum(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def jukes_cantor(d: Column) -> Column:
    """Substitutions a site from the share of differing sites; infinite from 3/4 on."""
    return F.when(d < 0.75, -0.75 * F.log(1 - d * (4.0 / 3))).otherwise(F.lit(math.inf))


def expected_shulen(d: float, p: float, length: int) -> float:
    """Expected length of the shortest unique substring at divergence d (Haubold et al., 2009).

    p is half the GC share. A substring of x bases is absent from the other sequence by chance,
    or because one of its bases has changed.
    """

    if d <= 0:
        return float(length)
    # The mean is the sum over x of the chance that a substring of x bases is not yet unique. Logarithms throughout: the
    # binomials and powers leave the range of floating point from about 50 bases on.
    gc, at = (math.log(y) if y > 0 else -math.inf for y in (p, 0.5 - p))
    total, factorials, log_kept, x = 0.0, np.zeros(1), math.log1p(-d) if d < 1 else -math.inf, 0
    while x < length:
        same = math.exp(x * log_kept) if x else 1.0
        if len(factorials) <= x:
            factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * x + 2)))])
        k = np.arange(x + 1)
        word = np.where(k > 0, k * max(gc, -1e300), 0) + np.where(k < x, (x - k) * max(at, -1e300), 0)
        ways = factorials[x] - factorials[k] - factorials[x - k] + x * math.log(2)
        chance = float(np.exp(ways + word + length * np.log1p(-np.minimum(np.exp(word), 1 - 1e-16))).sum())
        if 1 - chance < 1e-12:
            # Chance has nothing left to say: what follows is a geometric series.
            return total + same * (1 - math.exp((length - x) * log_kept)) / d
        total += 1 - chance * (1 - same)
        if chance * (1 - same) > 1 - 1e-12:
            break
        x += 1
    return total


def divergence(shulen: float, p: float, length: int, error: float = 1e-5) -> float:
    """Divergence whose expected shustring length is `shulen`, by bisection."""
    low, high = 0.0, 1.0
    while high - low > error:
        mid = (low + high) / 2
        low, high = (mid, high) if expected_shulen(mid, p, length) > shulen else (low, mid)
    return (low + high) / 2
