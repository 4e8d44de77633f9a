"""The normal quantile by its published rational approximation, and the terms of the Cornish-Fisher expansion."""

from __future__ import annotations

from math import log, sqrt

# Coefficients of the published approximation, highest power first.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def horner(coefficients: tuple[float, ...], x: float) -> float:
    total = 0.0
    for c in coefficients:
        total = total * x + c
    return total


def normal_quantile(p: float) -> float:
    if p > 1 - TAIL:
        return -normal_quantile(1 - p)
    if p < TAIL:
        r = sqrt(-2 * log(max(p, 1e-300)))
        return horner(TAIL_TOP, r) / horner(TAIL_BOTTOM, r)
    r = p - 0.5
    return r * horner(CENTRE_TOP, r * r) / horner(CENTRE_BOTTOM, r * r)


def expansion_terms(q: float) -> tuple[float, float, float, float]:
    """z and the factors of skewness, excess kurtosis and squared skewness at quantile q."""
    z = normal_quantile(q)
    return z, (z * z - 1) / 6, (z ** 3 - 3 * z) / 24, (2 * z ** 3 - 5 * z) / 36
