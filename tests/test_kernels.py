import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import count_models as C
from lattica.functions import special as S
from lattica.operators import segments, spatial, spins
from lattica.operators.graph import components


def test_special_functions():
    x = np.array([0.01, 0.5, 1, 3.3, 50])
    assert np.allclose(S.gammaln(x), [math.lgamma(v) for v in x], atol=1e-10)
    assert abs(S.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10
    assert abs(S.t_p_value(2.228138852, 10) - 0.05) < 1e-6
    assert abs(S.f_p_value(4.964602744, 1, 10) - 0.05) < 1e-6
    assert abs(S.normal_p_value(1.959963985) - 0.05) < 1e-8


def test_count_likelihoods_agree():
    y, mu, r = np.array([0.0, 1, 4, 9]), np.array([1.0, 2, 3, 5]), 2.5
    direct = sum(math.lgamma(a + r) - math.lgamma(r) - math.lgamma(a + 1) + r * math.log(r / (r + m)) + a * math.log(m / (r + m)) for a, m in zip(y, mu, strict=True))
    assert abs(C.nb_loglik_log(y, mu, r) - direct) < 1e-9
    assert abs(C.nb_loglik_logit(y, np.log(mu / r), r) - direct) < 1e-9


def test_regression_recovers_and_mode_meets_draws():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(600), np.linspace(0, 1, 600)])
    mu = np.exp(1 + 0.8 * x[:, 1])
    y = rng.negative_binomial(3, 3 / (3 + mu))
    fit = C.nb_glm(y, x)
    assert fit["status"] == "ok" and abs(fit["beta"][1] - 0.8) < 3 * fit["se"][1] and 2 < fit["theta"] < 5
    beta, _, _ = C.nb_map(y, x)
    draws, sizes = C.nb_gibbs(y, x, 80)
    assert np.abs(beta - draws.mean(axis=0)).max() < 0.15 and 1.5 < sizes.mean() < 5
    assert C.nb_glm(np.zeros(9), x[:9])["status"] == "undetermined"


def test_draws_of_the_size_use_sums_of_the_counts(monkeypatch):
    """The likelihood of a size takes the counts' numbers, not every row again, and is the plain one but for a constant."""
    rng = np.random.default_rng(3)
    for y in (rng.negative_binomial(3, 0.05, 50).astype(float), np.array([0.0, 0, 1]), np.array([4e6, 3, 4e6]), np.zeros(4)):
        psi = rng.normal(size=len(y))
        rest = C._rising_logs(y)
        own = [rest(v) - v * np.logaddexp(0, psi).sum() - C.nb_loglik_logit(y, psi, v) for v in (0.01, 1.0, 7.5, 300.0)]
        assert np.ptp(own) < 1e-6 * max(1.0, y.max())
    x = np.column_stack([np.ones(50), np.linspace(0, 1, 50)])
    y = rng.negative_binomial(3, 0.05, 50)
    monkeypatch.setattr(C, "nb_loglik_logit", None)
    assert len(C.nb_gibbs(y, x, 10)[1]) == 10


def test_pruned_segmentation_is_exact():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 30):
        y = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(5, 1, n - n // 2)])
        cost = segments.gaussian_cost(y)
        a, b = segments.partitioned(n, cost, 3.0), segments.partitioned(n, cost, 3.0, prune=False)
        assert abs(a[0] - b[0]) < 1e-9 and a[1] == b[1]
        assert [p for s, e in a[1] for p in range(s, e + 1)] == list(range(1, n + 1)) and all(e > s for s, e in a[1])


def test_mixed_model_without_group_effect_is_least_squares():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(80), rng.normal(size=80)])
    y = x @ [1.0, 2.0] + rng.normal(size=80)
    beta, se, ratio = C.mixed_model(y, x, np.arange(80) % 8)
    assert np.abs(beta - np.linalg.lstsq(x, y, rcond=None)[0]).max() < 0.05 and ratio < 0.5


@pytest.fixture(scope="module")
def small(spark):
    spots = spark.createDataFrame([(i, float(i % 3), float(i // 3)) for i in range(9)], "spot_id long, x double, y double")
    return spots, spatial.neighbours(spots, 1.0)


def test_edges_are_symmetric(small):
    got = {(r["src"], r["dst"]) for r in small[1].collect()}
    assert len(got) == 24 and all((b, a) in got for a, b in got)


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "spot_id long")
    edges = spark.createDataFrame([(0, 3), (3, 5), (5, 6), (1, 2)], "src long, dst long")
    assert {r["spot_id"]: r["component"] for r in components(nodes, edges).collect()} == {0: 0, 3: 0, 5: 0, 6: 0, 1: 1, 2: 1, 4: 4, 7: 7}


def test_chains_meet_enumeration(spark, small):
    spots, edges = small
    pairs = [(r["src"], r["dst"]) for r in edges.collect() if r["src"] < r["dst"]]
    j, z, total, plus = 0.3, 0.0, 0.0, 0.0
    for s in itertools.product([-1, 1], repeat=9):
        e = sum(s[a] * s[b] for a, b in pairs)
        z, total = z + math.exp(j * e), total + e * math.exp(j * e)
        plus += (s[4] > 0) * math.exp(j * e)
    # a flip is accepted with exp(j * change of the sum), so the chain's law is exp(j * sum)
    chains = spark.createDataFrame([(i, j) for i in range(4)], "chain long, j double")
    got = [r["mean_sum"] for r in spins.metropolis(spots.select("spot_id"), edges, chains, 60_000, 50_000, block=60_000).collect()]
    assert abs(np.mean(got) - total / z) < 0.35
    one = spark.createDataFrame([(0, j, 0.0)], "chain long, j double, factor double")
    none = spark.createDataFrame([], "spot_id long, n_add long")
    probs = spins.gibbs(spots.select("spot_id"), edges, none, one, 4000, 200, scale=2.0).collect()
    assert abs({r["spot_id"]: r["prob"] for r in probs}[4] - plus / z) < 0.08


def test_tiles_keep_the_law_of_the_chain(spark):
    """A path of 13 spots over tiles of four: means of all states by enumeration, with a field, for both kinds of chain."""
    n, j, factor = 13, 0.4, 1.5
    spots = spark.createDataFrame([(i, float(i), 0.0) for i in range(n)], "spot_id long, x double, y double")
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in (a - 1, a + 1, a + 2, a - 2) if 0 <= b < n], "src long, dst long")
    bonus = spark.createDataFrame([(0, 2), (6, 1)], "spot_id long, n_add long")
    pairs = [(a, b) for a in range(n) for b in (a + 1, a + 2) if b < n]
    states = np.array(list(itertools.product([-1, 1], repeat=n)))
    agree = sum(states[:, a] * states[:, b] for a, b in pairs)
    law = np.exp(j / 2 * (agree + factor * (2 * states[:, 0] + states[:, 6])))
    plus = ((states > 0) * law[:, None]).sum(axis=0) / law.sum()
    chains = spark.createDataFrame([(i, j, factor) for i in range(40)], "chain long, j double, factor double")
    found = spins.gibbs(spots, edges, bonus, chains, 1600, 200, block=100, tile=1.0).collect()
    assert len(found) == 40 * n
    for i in range(n):
        assert abs(np.mean([r["prob"] for r in found if r["spot_id"] == i]) - plus[i]) < 0.02, i
    free = np.exp(j * agree)
    got = [r["mean_sum"] for r in spins.metropolis(spots, edges, chains.select("chain", F.lit(j).alias("j")), 600, 400, block=40, tile=1.0).collect()]
    assert len(got) == 40 and abs(np.mean(got) - (agree * free).sum() / free.sum()) < 0.4


def test_a_tile_sees_its_own_spots_only(spark, monkeypatch):
    """No task gets more than one tile of the graph, and a spot at a tile's border rests."""
    rows = pd.DataFrame({"spot_id": [3, 1, 2], "near": [[2, 9], [2], [1, 3]], "_lane": 0, "s": [b"\x01"] * 3, "n_add": 0.0, "hits": [bytes(4)] * 3, "n": 0, "pairs": None, "_tile": 0})
    near, free = spins._in_tile(rows.sort_values("spot_id", ignore_index=True))
    assert near.tolist() == [[1, 3], [0, 2], [1, 3]] and free.tolist() == [True, True, False]
    classes = spins._classes(near, free)
    assert sorted(i for c in classes for i in c.tolist()) == [0, 1] and all(len(c) == 1 for c in classes)
    out = spins._run_block(rows, [np.array([[0.0], [0.3], [0.0]])], "gibbs", 1.0, 1, 0, 50, 10)
    assert out["s"].iloc[2] == b"\x01" and out["n"].tolist() == [40, 40, 0]


def test_empty_inputs(spark):
    spots = spark.createDataFrame([], "spot_id long, x double, y double")
    assert spatial.unit_distance(spots) == 0.0
    assert spatial.neighbours(spots, 1.0).count() == 0
    assert components(spots, spatial.neighbours(spots, 1.0)).count() == 0
    assert spatial.lines(spots, 1.0).count() == 0


def test_tiles_that_share_a_task_keep_their_streams():
    """Tiles are swept together, yet each as if it were alone: neighbours in another tile rest, and draws do not depend on who shares the task."""
    near = [[1], [0, 2], [1, 3], [2, 4], [3, 5], [4]]
    rows = pd.DataFrame({"spot_id": range(6), "near": near, "_lane": 0, "s": [b"\x01\xff" * 20] * 6, "n_add": 0.0, "hits": [bytes(4 * 40)] * 6, "n": 0, "pairs": None, "_tile": [7, 7, 7, 8, 8, 8]})
    lanes = [np.array([[c, 0.3, 0.0] for c in range(40)]).T]
    for kind in ("gibbs", "metropolis"):
        run = lambda r, kind=kind: spins._run_block(r, lanes, kind, 1.0, 1, 0, 30, 10).set_index("spot_id")
        both, alone = run(rows), pd.concat([run(rows[:3]), run(rows[3:])])
        assert both["s"].to_dict() == alone["s"].to_dict() and both["hits"].to_dict() == alone["hits"].to_dict()
        assert both["rests"].tolist() == [False, False, True, True, False, False]
        if kind == "metropolis":
            value = lambda f: sum(np.frombuffer(v) for v in f["pairs"].dropna())
            assert np.array_equal(value(both), value(alone))
