"""Statistics as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .ordered import least_from, numbered_gaps, row_numbers


def average_rank(order: Column | str, by: list[str]) -> Column:
    """Rank from 1 within ``by``, ties sharing their mean."""
    col = F.col(order) if isinstance(order, str) else order
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, col))
    return F.rank().over(Window.partitionBy(*by).orderBy(col)) + (ties - 1) / 2.0


def adjusted(df: DataFrame, p: str, key: str, method: str = "BH", by: list[str] | None = None) -> DataFrame:
    """Adds ``p_adj``: Benjamini-Hochberg, or Benjamini-Yekutieli (times the harmonic sum), of non-null p.

    ``key`` settles equal p-values.  Tests are ordered within ``by`` (default: all together) in ranges of p (see
    :mod:`ordered`), so any number of tests will do.
    """
    by = by or []
    numbered = row_numbers(df.where(F.col(p).isNotNull()), [p, key], "_rk", by)
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    factor = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k) if method == "BY" else F.lit(1.0)
    sizes = sizes.withColumn("_f", factor)
    sized = numbered.join(sizes, by) if by else numbered.join(F.broadcast(sizes))  # without groups one row
    least = least_from(sized, ["_rk"], F.col(p) * F.col("_n") / F.col("_rk"), "_least", by)
    return least.withColumn("p_adj", F.least(F.lit(1.0), F.col("_least") * F.col("_f"))).select(*df.columns, "p_adj")


def welch(m0: Column, v0: Column, n0: Column, m1: Column, v1: Column, n1: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of the two-sample test with unequal variances (Welch 1947)."""
    a, b = v0 / n0, v1 / n1
    return (m0 - m1) / F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))


def rand_index(labels: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``by, ari``: adjusted Rand index (Hubert and Arabie 1985) from the table of joint counts; null if undefined."""
    pairs = lambda c: c * (c - 1) / 2.0
    cells = labels.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    one = cells.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("left"))
    two = cells.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("right"))
    tt = pairs(F.col("total"))
    expected = F.col("left") * F.col("right") / tt
    spread = (F.col("left") + F.col("right")) / 2 - expected
    return both.join(one, by).join(two, by).select(*by, F.when((tt > 0) & (spread != 0), (F.col("both") - expected) / spread).alias("ari"))


def partial(r12: Column, r13: Column, r23: Column) -> Column:
    """Correlation of 1 and 2 given 3."""
    return (r12 - r13 * r23) / F.sqrt((1 - r13 * r13) * (1 - r23 * r23))


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def islands(coords: DataFrame, value: str, cutoff: float | Column, digits: int = 6, by: list[str] | None = None) -> DataFrame:
    """``by, _v, island``: distinct rounded values, numbered from 1 within ``by``, a new number where the gap is ``cutoff`` or more."""
    return numbered_gaps(coords.select(*(by or []), F.round(value, digits).alias("_v")).distinct(), "_v", cutoff, "island", by)
