"""Ordered scans and order statistics over tables of any size: no order is held by one task, no state by one row.

A scan deals rows to ranges of the order, works inside each range by a window, and carries what the ranges before hold: one
row a range (and group), which is as small as the number of partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

#: Ranges that a counting pass cuts each interval into.
_CUTS = 4096


def in_ranges(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` plus ``_part``: rows dealt to ranges of ``by`` and ``order``, written once, so that ranges stay as they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *(by or []), *order).withColumn("_part", F.spark_partition_id()))


def _carried(df: DataFrame, by: list[str], value: Column, fold, name: str, back: bool = False) -> DataFrame:
    """``by, _part, name``: ``fold`` of ``value`` over the ranges before (``back``: after) each range of a group."""
    place = F.col("_part").desc() if back else F.col("_part")
    own = df.groupBy(*by, "_part").agg(value.alias("_v"))
    before = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return own.select(*by, "_part", fold(F.col("_v")).over(before).alias(name))


def _with(df: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    return df.join(F.broadcast(carried), "_part") if not by else df.join(carried, [*by, "_part"])  # without groups: one row a range


def row_numbers(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` plus ``name``, the row's number from 1 in ``order`` (within ``by``), and ``_part``, its range."""
    by = by or []
    dealt = in_ranges(df, order, by)
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    known = _with(dealt, _carried(dealt, by, F.count(F.lit(1)), F.sum, "_c"), by)
    return known.withColumn(name, (own + F.coalesce("_c", F.lit(0))).cast("long")).drop("_c")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """``df`` plus, for each ``name: column`` of ``totals``, the sum of the column over this row and those before it; rows of ``order`` are different."""
    dealt = in_ranges(df, order)
    known = dealt
    for name, value in totals.items():
        known = _with(known, _carried(dealt, [], F.sum(value), F.sum, f"_{name}"), [])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumns({name: F.sum(value).over(own) + F.coalesce(f"_{name}", F.lit(0)) for name, value in totals.items()})
    return known.drop("_part", *[f"_{name}" for name in totals])


def least_from(df: DataFrame, order: list[str], value: Column, name: str, by: list[str]) -> DataFrame:
    """``df`` (with ``_part``) plus ``name``, the least ``value`` of this row and those after it in ``order``, within ``by``."""
    own = F.min(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    known = _with(df, _carried(df, by, F.min(value), F.min, "_c", back=True), by)
    return known.withColumn(name, F.least(own, F.col("_c"))).drop("_c")


def numbered_gaps(distinct: DataFrame, value: str, cutoff: float | Column, name: str, by: list[str] | None = None) -> DataFrame:
    """``distinct`` plus ``name``: a number from 1 (within ``by``) that grows by 1 wherever ``value`` is ``cutoff`` or more above the one before."""
    by = by or []
    dealt = in_ranges(distinct, [value], by)
    order = Window.partitionBy(*by, "_part").orderBy(value)
    dealt = _with(dealt, _carried(dealt, by, F.max(value), F.max, "_last"), by)
    gap = F.coalesce((F.col(value) - F.coalesce(F.lag(value).over(order), F.col("_last")) >= cutoff).cast("int"), F.lit(0))
    marked = dealt.withColumn("_gap", gap).drop("_last")
    own = F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = _with(marked, _carried(marked, by, F.sum("_gap"), F.sum, "_c"), by)
    return known.withColumn(name, own + F.coalesce("_c", F.lit(0)) + 1).drop("_gap", "_c", "_part")


# ----------------------------------------------------------- order statistics


def order_statistics(values: DataFrame, col: str, ranks: list[int]) -> list[float]:
    """The values of ``ranks`` (from 0) in ascending order, by counting.

    Every pass counts the values in equal parts of each interval that still holds a rank, with each part's least and greatest value, and
    goes on with the part that holds it; it ends where these are equal.  A pass keeps as many rows as it has parts.
    """
    data = written(values.select(F.col(col).cast("double").alias("v")).where("v is not null"))
    low, high = data.agg(F.min("v"), F.max("v")).first()
    open_ = {k: (low, high, k) for k in set(ranks)}  # rank: interval, and the rank inside it
    found: dict[int, float] = {}
    while True:
        for k, (a, b, _) in list(open_.items()):
            if a == b:
                found[k] = a
                del open_[k]
        if not open_:
            return [found[k] for k in ranks]
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        cell = None
        for i, (a, b) in enumerate(spans):
            part = F.least(F.floor((F.col("v") - a) / (b - a) * _CUTS), F.lit(_CUTS - 1)) + i * _CUTS
            inside = (F.col("v") >= a) & (F.col("v") <= b)
            cell = F.when(inside, part) if cell is None else cell.when(inside, part)
        parts = data.withColumn("_c", cell).where("_c is not null").groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_c").collect()  # one row a part
        for k, (a, b, left) in list(open_.items()):
            i = spans.index((a, b))
            for r in parts:
                if r["_c"] // _CUTS == i:
                    if left < r["n"]:
                        open_[k] = (r["a"], r["b"], left)
                        break
                    left -= r["n"]


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the non-null values, between two values by the share; None without values."""
    data = written(df.select(F.col(col).cast("double").alias("v")).where("v is not null"))
    n = data.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ranks = sorted({k for p in at for k in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, order_statistics(data, "v", ranks), strict=True))
    out = []
    for p in at:
        a, b = math.floor(p), math.ceil(p)
        out.append(value[a] if a == b or value[a] == value[b] else (b - p) * value[a] + (p - a) * value[b])
    return out


def smallest(df: DataFrame, col: str, wanted: int) -> DataFrame:
    """The ``wanted`` rows of ``df`` (a written table) with the smallest values of ``col``, a 64-bit hash; all, if there are fewer."""
    n = df.count()
    if n <= wanted or wanted <= 0:
        return df if wanted > 0 else df.where("false")
    high = F.shiftright(F.col(col), 11)  # 53 bits are exact as a double
    cut = order_statistics(df.select(high.cast("double").alias("v")), "v", [wanted - 1])[0]
    sure = df.where(high < int(cut))
    edge = df.where(high == int(cut)).orderBy(col).limit(wanted - sure.count())  # rows whose hashes agree in 53 bits
    return sure.unionByName(edge)


def difference_quantile(df: DataFrame, col: str, share: float, ways: int = 15, listed: int = 20_000) -> float:
    """Quantile ``share`` of the absolute differences of all ordered pairs of values, a value with itself included; 0 without values.

    Ranks are searched: a pass counts, for ``ways`` bounds at once, the pairs whose difference is within them, from the values in order with running
    totals, and goes on between the two bounds that enclose the rank.  Only when at most ``listed`` pairs of different values are between them are
    their differences made.
    """
    values = written(df.select(F.col(col).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    n, same, low, high, m = values.agg(F.sum("c"), F.sum(F.col("c") * F.col("c")), F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return 0.0
    at = share * (n * n - 1)
    place = lambda k: None if k < same else (k - same) // 2  # noqa: E731  zeros come first, every other difference twice
    ranks = [place(math.floor(at)), place(math.ceil(at))]

    def within(bounds: list[float]) -> list[tuple[int, int]]:
        """For each bound the unordered pairs of different values with a difference of it or less: all, and those of distinct values."""
        grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(b)).alias("b")) for k, b in enumerate(bounds)])
        none = F.lit(0).cast("long")
        asks = values.select("v", "c", F.explode(grid).alias("g")).select((F.col("v") + F.col("g.b")).alias("at"), F.lit(1).alias("ask"), F.col("g.k").alias("k"), F.col("v").alias("of"), F.col("c").alias("w"), none.alias("c"), none.alias("one"))
        own = values.select(F.col("v").alias("at"), F.lit(0).alias("ask"), F.lit(-1).alias("k"), F.col("v").alias("of"), none.alias("w"), "c", F.lit(1).cast("long").alias("one"))
        counted = running_totals(own.unionByName(asks), ["at", "ask", "k", "of"], {"upto": "c", "kinds": "one"}).where("ask = 1")
        sums = counted.groupBy("k").agg(F.sum(F.col("w") * F.col("upto")).alias("s"), F.sum("kinds").alias("d")).orderBy("k").collect()  # one row a bound
        return [(r["s"] - (n * n + same) // 2, r["d"] - (m * m + m) // 2) for r in sums]  # less each value with itself and with those below it

    def band(rank: int) -> tuple[int, list[tuple[float, int]]]:
        """(pairs below, differences with their numbers) of a band that holds the rank."""
        a, b, under, kinds, last = 0.0, high - low, 0, (0, m * (m - 1) // 2), None
        while kinds[1] - kinds[0] > listed and last != (a, b):
            last = (a, b)
            bounds = [a + (b - a) * (k + 1) / (ways + 1) for k in range(ways)]
            for bound, (count, kind) in zip(bounds, within(bounds), strict=True):
                if count > rank:
                    b, kinds = bound, (kinds[0], kind)
                    break
                a, under, kinds = bound, count, (kind, kinds[1])
        width = max(b - a, (high - low) * 1e-15)
        cell = lambda c: F.floor(c / width).cast("long")
        left = values.select(F.col("v").alias("u"), F.col("c").alias("d"), F.explode(F.sequence(cell(F.col("v") + a), cell(F.col("v") + b))).alias("cell"))
        met = left.join(values.select("v", "c", cell(F.col("v")).alias("cell")), "cell").where((F.col("v") > F.col("u") + a) & (F.col("v") <= F.col("u") + b) & (F.col("v") > F.col("u")))
        rows = met.groupBy((F.col("v") - F.col("u")).alias("gap")).agg(F.sum(F.col("c") * F.col("d")).alias("n")).orderBy("gap").collect()  # ``listed`` rows at most
        return under, [(r["gap"], r["n"]) for r in rows]

    bands: list[tuple[int, list[tuple[float, int]]]] = []

    def value(rank: int | None) -> float:
        if rank is None:
            return 0.0
        if not bands or not bands[-1][0] <= rank < bands[-1][0] + sum(k for _, k in bands[-1][1]):
            bands.append(band(rank))
        under, rows = bands[-1]
        for gap, k in rows:
            under += k
            if rank < under:
                return gap
        return rows[-1][0]

    one, two = value(ranks[0]), value(ranks[1])
    return one if one == two else (math.ceil(at) - at) * one + (at - math.floor(at)) * two


__all__ = ["difference_quantile", "in_ranges", "least_from", "numbered_gaps", "order_statistics", "quantiles", "row_numbers", "running_totals", "smallest"]
