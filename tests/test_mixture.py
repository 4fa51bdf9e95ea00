"""The two-part mixture against expectation and maximisation over single values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import mixture
from lattica.plans import queries as Q


def single(values, equal, rounds=4000):
    """(log likelihood, weights, means, variances) over the values themselves."""
    best = None
    for q in (0.1, 0.25, 0.5, 0.75, 0.9):
        r = np.stack([values <= np.quantile(values, q), values > np.quantile(values, q)]).astype(float)
        for _ in range(rounds):
            mass = np.maximum(r.sum(axis=1), 1e-12)
            mean = r @ values / mass
            square = (r * (values - mean[:, None]) ** 2).sum(axis=1)
            var = np.maximum(np.full(2, square.sum() / len(values)) if equal else square / mass, 1e-6 * values.var())
            dens = (mass / len(values) / np.sqrt(2 * np.pi * var))[:, None] * np.exp(-((values - mean[:, None]) ** 2) / (2 * var[:, None]))
            r = dens / dens.sum(axis=0)
        found = float(np.log(dens.sum(axis=0)).sum())
        if best is None or found > best[0]:
            best = (found, mass / len(values), mean, var)
    return best


@pytest.mark.parametrize(("low", "high", "model"), [(1.5, 1.5, "E"), (1.0, 6.0, "V")])
def test_whole_numbers_lose_nothing(spark, low, high, model):
    rng = np.random.default_rng(4)
    values = np.round(np.concatenate([rng.normal(10, low, 500), rng.normal(24, high, 300)]))
    cells = mixture.histogram(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v")
    assert cells[:, 0].sum() == 800 and (cells[:, 2] < 1e-20).all()
    found = mixture.two_parts(cells)
    assert found.model == model
    for name, free in (("E", 4), ("V", 5)):
        assert found.bic[name] == pytest.approx(2 * single(values, name == "E")[0] - free * np.log(800), abs=1e-3)
    _, weight, mean, var = single(values, model == "E")
    order = np.argsort(mean)
    assert np.allclose(found.means, mean[order], atol=1e-4) and np.allclose(found.weights, weight[order], atol=1e-4) and np.allclose(found.variances, var[order], rtol=1e-3)


def test_many_values_and_odd_tables(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(8, 2, 1000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found, fine = mixture.two_parts(mixture.histogram(df, "v")), single(values, False, 300)
    assert found.model == "V" and np.allclose(sorted(fine[2]), found.means, atol=0.01)
    upper = df.where(mixture.in_upper_part(F.col("v"), found)).count()
    assert abs(upper - 1000) < 40
    assert mixture.two_parts(mixture.histogram(df.where("false"), "v")) is None
    assert mixture.two_parts(mixture.histogram(df.select(F.lit(3.0).alias("v")), "v")) is None


def test_states_of_the_given_spots(spark, sf):
    from lattica.plans.shared import scored_spots

    sums = {r["spot_id"]: float(r["ex_sum"]) for r in scored_spots(spark, sf).collect()}
    values = np.array(list(sums.values()))
    fits = {name: single(values, name == "E") for name in "EV"}
    n = len(values)
    name = max("EV", key=lambda k: 2 * fits[k][0] - (4 if k == "E" else 5) * np.log(n))
    _, w, m, v = fits[name]
    high = int(np.argmax(m))
    log = [np.log(w[k]) - 0.5 * np.log(v[k]) - (values - m[k]) ** 2 / (2 * v[k]) for k in (0, 1)]
    want = dict(zip(sums, np.where(log[high] > log[1 - high], -1, 1).tolist(), strict=True))
    got = {r["spot_id"]: r["s"] for r in Q.q_states(spark, sf).collect()}
    assert sum(got[k] != want[k] for k in want) <= 1 and len(got) == n
