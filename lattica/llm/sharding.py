"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 without a global sort: distinct key tuples fall into hash buckets,
a bucket's rows are numbered in key order, and a bucket's offset is the sum of the buckets
before it (one small aggregate).  How many buckets there are follows from n.  The permutation then maps a row number to its place in the
shuffled order; ``place mod shards`` is the shard and ``place div shards`` the slot, so both are
computable from the number alone and shard counts differ by one at most.

All steps are built-in Spark functions; the only shuffled columns are the keys and the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, row_key

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square rectangle with a * b >= n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation of [0, a*b): halves are changed in turn by a keyed hash of the other."""

    def noise(i: Column, half: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), half.cast("string"))), F.lit(size).cast("long"))

    def turn(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, (acc["l"] + noise(i, acc["r"], a)) % a).otherwise(acc["l"])
        right = F.when(i % 2 == 1, acc["r"]).otherwise((acc["r"] + noise(i, acc["l"], b)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["l"] * b + acc["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """Place of row ``x`` among ``n``: the permutation is applied until the value is below ``n``.

    At most a*b - n + 1 passes are ever needed (that many values lie outside).  Passes go in two lengths, the
    second is reached with a probability below n**-32; a value still outside after it ends the job with an error.
    """
    a, b = domain(n)
    once = feistel(x, a, b, seed)
    inside = lambda y: F.when(y < n, y)
    walk = lambda y, passes: F.aggregate(F.sequence(F.lit(1), F.lit(passes)), y, lambda z, _: inside(z).otherwise(feistel(z, a, b, seed)))
    outside = a * b - n
    if not outside:
        return once
    near = walk(once, min(outside, 64))
    if outside <= 64:
        return near
    # one more element binds the first walk's end, so that it is computed once
    far = lambda y: inside(y).otherwise(walk(y, min(outside, 100_000)))
    checked = lambda y: inside(y).otherwise(F.raise_error(F.lit("a value did not walk into the range")).cast("long"))
    return F.element_at(F.transform(F.transform(F.array(near), far), checked), 1)


def bucket_count(n: int) -> int:
    """Buckets of about 50,000 rows, from the number of rows alone: 64 at least and 2**20 at most."""
    return min(max(64, 1 << max(n // 50_000, 1).bit_length()), 1 << 20)


def numbered(df: DataFrame, keys: list[str], buckets: int | None = None) -> tuple[DataFrame, int]:
    """(``key``, a struct of the ``keys``, of every row plus ``row_no``, number of rows).

    Repeated key tuples are counted before the shuffle and expanded after it, so a tuple that
    holds a third of all rows costs one row in its bucket.  Null keys are values like others.
    Numbers depend on the rows and ``buckets`` only, never on the session or the partitioning.
    """
    names = [f"k{i}" for i in range(len(keys))]
    counted = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted.withColumn("hash", F.xxhash64(row_key(*names))))
    total = counted.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or bucket_count(total)
    counted = counted.withColumn("b", F.pmod("hash", F.lit(buckets)))
    sizes = counted.groupBy("b").agg(F.sum("n").alias("t"))  # one row a bucket, 2**20 at most: small enough for one window and a broadcast
    offsets = sizes.select("b", (F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    by_key = Window.partitionBy("b").orderBy(*[F.col(k).asc_nulls_first() for k in names])
    within = F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = counted.withColumn("within", within).join(F.broadcast(offsets), "b").withColumn("first", F.col("before") + F.col("within"))
    key = F.struct(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)])
    return rows.select(key.alias("key"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("row_no")), total


def feistel_shards(df: DataFrame, keys: list[str], shards: int, seed: int = 20240607, buckets: int | None = None) -> DataFrame:
    """``keys``, ``row_no``, ``shard`` and ``slot`` of every row of ``df``.

    Law ``rows``: shard counts differ by one at most and a shard's slots are 0, 1, 2, ...
    The same rows give the same result whatever their order, their partitioning or the session's settings.
    Repeated rows each get a place; nulls are ordinary keys; an empty table gives an empty result.  Other
    columns are ignored; a key named like a column of the result counts but is not returned.
    """
    rows, n = numbered(df, keys, buckets)
    kept = [F.col("key").getField(k).alias(k) for k in keys if k not in ("row_no", "shard", "slot")]
    placed = rows.withColumn("place", permuted(F.col("row_no"), max(n, 1), seed))
    return placed.select(*kept, "row_no", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))
