"""Confidence bounds, stars and the tail areas behind p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import _col

#: Fixed value: two-sided 95% normal quantile as used for every band.
Z95 = 1.96


def ci_low(estimate: Column | str, std_error: Column | str) -> Column:
    return _col(estimate) - Z95 * _col(std_error)


def ci_high(estimate: Column | str, std_error: Column | str) -> Column:
    return _col(estimate) + Z95 * _col(std_error)


def stars(p: Column | str) -> Column:
    p = _col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, dof: float) -> float:
    """Two-sided Student tail: the regularised incomplete beta function at dof / (dof + t^2)."""
    if math.isnan(t):
        return float("nan")
    return _beta_ratio(dof / 2.0, 0.5, dof / (dof + t * t))


def _beta_ratio(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value
