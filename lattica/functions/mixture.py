"""A mixture of two normal parts with the choice between one variance and two, fitted on a histogram that Spark counts."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the histogram: as many rows at most come to the driver, whatever the size of the table.
BINS = 4096


class TwoParts(NamedTuple):
    """Weights, means and variances of the parts by ascending mean; ``model`` is E (equal variances) or V, ``bic`` of both by name (greater is better)."""

    model: str
    weights: tuple[float, float]
    means: tuple[float, float]
    variances: tuple[float, float]
    bic: dict[str, float]


def histogram(values: DataFrame, col: str, bins: int = BINS) -> np.ndarray:
    """Rows (number, mean, variance) of the values of each bin, by value: exact moments, so few distinct values lose nothing."""
    v = F.col(col).cast("double")
    low, high = values.agg(F.min(v), F.max(v)).first()
    if low is None:
        return np.zeros((0, 3))
    cell = F.least(F.floor((v - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1))
    rows = values.where(v.isNotNull()).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")).orderBy("cell").collect()  # one row a bin
    return np.array([(r["n"], r["m"], r["s"]) for r in rows], float)


def _fit(cells: np.ndarray, equal: bool, split: float, floor: float, rounds: int, close: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, weights, means, variances) by expectation and maximisation from a split of the mass."""
    n, m, s = cells.T
    share = np.clip((split * n.sum() - (np.cumsum(n) - n)) / n, 0, 1)
    r = np.stack([share, 1 - share])
    last = -math.inf
    for _ in range(rounds):
        mass = np.maximum((r * n).sum(axis=1), 1e-12)
        mean = (r * n * m).sum(axis=1) / mass
        square = (r * n * ((m - mean[:, None]) ** 2 + s)).sum(axis=1)
        var = np.maximum(np.full(2, square.sum() / n.sum()) if equal else square / mass, floor)
        weight = mass / mass.sum()
        # a bin counts with its mean logarithmic density, which holds its inner variance too
        log = np.log(weight)[:, None] - 0.5 * (np.log(2 * math.pi * var)[:, None] + ((m - mean[:, None]) ** 2 + s) / var[:, None])
        top = log.max(axis=0)
        both = top + np.log(np.exp(log - top).sum(axis=0))
        r, total = np.exp(log - both), float((n * both).sum())
        if abs(total - last) <= close * (1 + abs(total)):
            break
        last = total
    return total, weight, mean, var


def two_parts(cells: np.ndarray, rounds: int = 5000, close: float = 1e-12) -> TwoParts | None:
    """The better of both variance models by the Bayesian information criterion, each the best of several starts; None without two different values."""
    n = cells[:, 0].sum()
    spread = float(np.average((cells[:, 1] - np.average(cells[:, 1], weights=cells[:, 0])) ** 2 + cells[:, 2], weights=cells[:, 0])) if n else 0.0
    if spread <= 0:
        return None
    fits = {}
    for name, free in (("E", 4), ("V", 5)):
        best = max((_fit(cells, name == "E", q, 1e-6 * spread, rounds, close) for q in (0.1, 0.25, 0.5, 0.75, 0.9)), key=lambda f: f[0])
        fits[name] = (2 * best[0] - free * math.log(n), best)
    model = max(fits, key=lambda k: (fits[k][0], k == "E"))
    _, (_, weight, mean, var) = fits[model]
    order = np.argsort(mean)
    pair = lambda v: (float(v[order[0]]), float(v[order[1]]))
    return TwoParts(model, pair(weight), pair(mean), pair(var), {k: f[0] for k, f in fits.items()})


def in_upper_part(value: Column, parts: TwoParts) -> Column:
    """Whether a value belongs to the part with the higher mean rather than to the other."""
    log = [math.log(w) - 0.5 * math.log(v) - (value - m) * (value - m) / (2 * v) for w, m, v in zip(parts.weights, parts.means, parts.variances, strict=True)]
    return log[1] > log[0]
