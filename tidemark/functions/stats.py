"""Tail probabilities, in plain Python as no numeric library with them is at hand."""

from __future__ import annotations

import math


def chi2_sf(x: float, k: int) -> float:
    """P(X > x) of chi-squared with a whole number k of degrees of freedom, by its closed recurrence."""
    if not x > 0:
        return 1.0
    h = x / 2
    if k % 2:
        total, term, i = math.erfc(math.sqrt(h)), math.sqrt(h) * math.exp(-h) / math.gamma(1.5), 1
    else:
        total, term, i = math.exp(-h), h * math.exp(-h), 2
    while i < k:
        total += term
        term *= h / (i / 2 + 1)
        i += 2
    return min(1.0, total)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|) of Student's t."""
    return 1.0 if dof <= 0 else incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))
