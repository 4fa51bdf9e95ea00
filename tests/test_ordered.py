"""Ordered scans, order statistics and draws against plain Python on values with ties, gaps and several ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import ordered, stats
from lattica.operators import trails


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(k, rng.choice("ab"), rng.choice([rng.randrange(40) / 4, rng.random() * 9]), rng.randrange(5)) for k in range(400)]
    return data, spark.createDataFrame(data, "k long, g string, v double, n long").repartition(3)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_and_adjustment(rows, by):
    data, df = rows
    got = {r["k"]: r["no"] for r in ordered.row_numbers(df, ["v", "k"], "no", by).collect()}
    for group in {r[1] if by else "" for r in data}:
        own = sorted((r for r in data if not by or r[1] == group), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    for method in ("BH", "BY"):
        found = {r["k"]: r["p_adj"] for r in stats.adjusted(df.withColumn("p", F.col("v") / 200), "p", "k", method, by).collect()}
        for group in {r[1] if by else "" for r in data}:
            own = sorted((r for r in data if not by or r[1] == group), key=lambda r: (r[2], r[0]))
            n, least = len(own), 1.0
            factor = sum(1 / i for i in range(1, n + 1)) if method == "BY" else 1.0
            for rank in range(n, 0, -1):
                least = min(least, own[rank - 1][2] / 200 * n / rank * factor)
                assert found[own[rank - 1][0]] == pytest.approx(least)
    assert stats.adjusted(df.withColumn("p", F.col("v")).where("false"), "p", "k").count() == 0


def test_totals_and_gaps(rows):
    data, df = rows
    got = {r["k"]: (r["s"], r["c"]) for r in ordered.running_totals(df.withColumn("one", F.lit(1)), ["v", "k"], {"s": "n", "c": "one"}).collect()}
    total = 0
    for place, r in enumerate(sorted(data, key=lambda r: (r[2], r[0]))):
        total += r[3]
        assert got[r[0]] == (total, place + 1)
    by = {(r["g"], r["v"]): r["no"] for r in ordered.numbered_gaps(df.select("g", "v").distinct(), "v", 0.1, "no", ["g"]).collect()}
    for g in "ab":
        values, no = sorted({r[2] for r in data if r[1] == g}), 1
        for last, v in zip([values[0], *values], values, strict=False):
            no += v - last >= 0.1
            assert by[g, v] == no


@pytest.mark.parametrize("kind", ["ties", "spread", "one", "tails"])
def test_quantiles(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    values = {"ties": rng.integers(0, 9, 700) / 3, "spread": rng.random(801), "one": np.full(50, 2.5), "tails": np.exp(rng.normal(0, 30, 500)) * rng.choice([-1, 1], 500)}[kind]
    monkeypatch.setattr(ordered, "_CUTS", 16)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
    assert ordered.quantiles(df, "v", shares) == want
    assert ordered.order_statistics(df, "v", [0, 5, 49]) == [float(np.sort(values)[k]) for k in (0, 5, 49)]
    assert ordered.quantiles(df.where("false"), "v", [0.5]) == [None]


@pytest.mark.parametrize("kind", ["whole", "real", "few", "same"])
def test_quantile_of_differences(spark, kind):
    rng = np.random.default_rng(3)
    values = {"whole": rng.integers(0, 60, 300), "real": rng.normal(size=250), "few": np.array([1.0, 4.0, 9.0]), "same": np.full(20, 3.0)}[kind].astype(float)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    full = np.abs(values[:, None] - values[None, :]).ravel()
    for share in (0.0, 0.05, 0.3, 1.0):
        assert ordered.difference_quantile(df, "v", share, listed=50 if share == 0.3 else 20_000) == pytest.approx(np.quantile(full, share), abs=1e-9), share
    assert ordered.difference_quantile(df.where("false"), "v", 0.5) == 0.0


def test_random_pairs(spark):
    places = {a * 30 + b: (a * 1.0, b * 1.0) for a in range(30) for b in range(30)}
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in places.items()], "spot_id long, x double, y double")
    far = lambda a, b: float(np.hypot(places[a][0] - places[b][0], places[a][1] - places[b][1]))
    drawn = [(r["src"], r["dst"]) for r in trails.random_pairs(nodes, 3.0, 7.0, 2000).collect()]
    assert len(drawn) == len(set(drawn)) == 2000 and all(a < b and 3 <= far(a, b) <= 7 for a, b in drawn)
    band = [far(a, b) for a in places for b in places if a < b and 3 <= far(a, b) <= 7]
    assert abs(np.mean([far(a, b) for a, b in drawn]) - np.mean(band)) < 0.08  # all pairs alike likely
    assert sorted(drawn) == sorted((r["src"], r["dst"]) for r in trails.random_pairs(nodes.repartition(5), 3.0, 7.0, 2000).collect())
    few = nodes.where("spot_id < 40")
    every = {(a, b) for a in range(40) for b in range(a + 1, 40) if 3 <= far(a, b) <= 7}
    assert {(r["src"], r["dst"]) for r in trails.random_pairs(few, 3.0, 7.0, 10_000).collect()} == every
    assert trails.random_pairs(nodes.where("false"), 3.0, 7.0, 10).count() == 0


def test_smallest(spark):
    rng = random.Random(1)
    hashes = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [7, 8, 9, 10]
    df = ordered.written(spark.createDataFrame([(h,) for h in hashes], "h long"))
    for n in (0, 1, 251, 252, 253, 254, 504, 900):
        assert sorted(r["h"] for r in ordered.smallest(df, "h", n).collect()) == sorted(hashes)[:n]
