"""Tail probabilities of test statistics, for the few numbers that a fit ends with."""

from __future__ import annotations

import math


def beta_share(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (Lentz's method)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # where the fraction converges fast
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, free: float) -> float:
    """The probability of a value of Student's t at least as far from 0, with ``free`` degrees of freedom; NaN where either is unknown."""
    if math.isnan(t) or not free > 0:
        return float("nan")
    return beta_share(free / (free + t * t), free / 2, 0.5)


def f_upper(f: float, above: float, below: float) -> float:
    """The probability of a value of F of at least ``f``."""
    if math.isnan(f) or not (above > 0 and below > 0):
        return float("nan")
    return beta_share(below / (below + above * f), below / 2, above / 2) if f > 0 else 1.0
