"""Special functions that neither Spark SQL nor numpy has, vectorised in numpy."""

from __future__ import annotations

import math

import numpy as np

#: Coefficients of Stirling's series of log gamma and digamma.
_LGAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)


def gammaln(x: np.ndarray) -> np.ndarray:
    """log gamma of positive values: raised above 8 by the recurrence, then Stirling's series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (low := x < 8).any():
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    series = sum(c / x ** (2 * k + 1) for k, c in enumerate(_LGAMMA))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (low := x < 8).any():
        shift = np.where(low, shift + 1 / np.where(low, x, 1.0), shift)
        x = np.where(low, x + 1, x)
    return np.log(x) - 0.5 / x - sum(c / x ** (2 * k + 2) for k, c in enumerate(_DIGAMMA)) - shift


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def f_p_value(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
