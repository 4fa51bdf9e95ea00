"""Operators against hand-computed cases and plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions.count_models import mixed_model, nb_glm, nb_loglik_logit, nb_map, nb_map_stretches
from lattica.functions.special import f_p_value, t_p_value
from lattica.operators import compare, graph, measures, paths, regress, segments, spatial, spins, trails
from lattica.plans import region
from lattica.sources import tables as T


def grid(n, m):
    """A triangular lattice of n rows and m columns: (id, x, y)."""
    return [(r * m + c, r * math.sqrt(3) / 2, c + 0.5 * (r % 2)) for r in range(n) for c in range(m)]


@pytest.fixture(scope="module")
def lattice(spark):
    return spark.createDataFrame(grid(7, 7), "spot_id long, x double, y double").cache()


# --------------------------------------------------------------------- spins


def test_bonus_by_hand(spark):
    """A row of six spots: 0 1 2 | 3 4 5, each stretch of three; the direction 90 leads to larger ids."""
    ends = spark.createDataFrame([(i, d) for i in (0, 2, 3, 5) for d in (90, -90)], "spot_id long, direction int")
    edges = spark.createDataFrame([(i, i + 1, 90) for i in range(5)] + [(i + 1, i, -90) for i in range(5)], "src long, dst long, direction int")
    margins = spark.createDataFrame([(0,), (5,)], "spot_id long")
    steep = spark.createDataFrame([(4, 90), (1, -90), (3, 90), (5, 90)], "spot_id long, direction int")
    bonus, regular = spins.end_bonus(ends, edges, steep, margins)
    # end 3 gives 4 a bonus along 90 and end 2 gives 1 one along -90; 2 -> 3 and 3 -> 2 are ends themselves
    assert sorted(map(tuple, bonus.collect())) == [(1, 1), (4, 1)]
    gone = {(r["src"], r["dst"]) for r in edges.collect()} - {(r["src"], r["dst"]) for r in regular.collect()}
    assert gone == {(4, 3), (1, 2)}
    # a margin that ends a stretch may receive: 5 is an end but a margin
    bonus, _ = spins.end_bonus(spark.createDataFrame([(4, 90), (5, 90)], ends.schema), edges, steep, margins)
    assert [tuple(r) for r in bonus.collect()] == [(5, 1)]


def test_steep_spots(spark):
    got = spins.steep_spots(spark.createDataFrame([(1, 30, -0.5), (2, 30, 0.5), (3, 90, -0.001), (4, 90, None), (5, 150, -1.0)], "spot_id long, direction int, slope double")).collect()
    assert sorted((r["spot_id"], r["direction"]) for r in got) == [(1, 30), (2, -150), (5, 150)]


def test_chains(spark, lattice):
    edges = spatial.neighbours(lattice, 1.2)
    nodes = lattice.select("spot_id", "x", "y")
    chains = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, -0.3)], "chain long, j double")
    sums = {r["chain"]: r["mean_sum"] for r in spins.metropolis(nodes, edges, chains, sweeps=400, tail=300, block=100, tile=1.0).collect()}
    n_pairs = edges.count() / 2
    assert sums[2] < -0.1 * n_pairs and abs(sums[0]) < 0.08 * n_pairs and sums[1] > 0.3 * n_pairs
    # without coupling the field alone decides: p = 1 / (1 + exp(-j * factor * n_add))
    alone = spark.createDataFrame([(0, 1), (1, 2)], "spot_id long, n_add long")
    lone = spark.createDataFrame([(0,), (1,), (2,)], "spot_id long")
    none = spark.createDataFrame([], "src long, dst long")
    probs = {r["spot_id"]: r["prob"] for r in spins.gibbs(lone, none, alone, spark.createDataFrame([(0, 0.5, 1.5)], "chain long, j double, factor double"), 3000, 500).collect()}
    for spot, n in ((0, 1), (1, 2), (2, 0)):
        assert abs(probs[spot] - 1 / (1 + math.exp(-0.5 * 1.5 * n))) < 0.04
    # two samples keep apart
    two = lattice.select(F.lit(1).alias("area"), "spot_id", "x", "y").union(lattice.select(F.lit(2), "spot_id", "x", "y"))
    both = spins.metropolis(two, edges.withColumn("area", F.explode(F.array(F.lit(1), F.lit(2)))), chains, 20, 5, sample="area").collect()
    assert len(both) == 6


def test_coupling_finds_the_chain_it_came_from(spark, lattice):
    edges, nodes = spatial.neighbours(lattice, 1.2), lattice.select("spot_id", "x", "y")
    seen = spins.metropolis(nodes, edges, spark.createDataFrame([(k, 0.3) for k in range(8)], "chain long, j double"), 60, 40, seed=5).agg(F.avg("mean_sum")).first()[0]
    fit = spins.fitted_coupling(nodes, edges, seen, [0.1, 0.2, 0.3, 0.4], draws=4, sweeps=60, tail=40).orderBy("abs_g").first()
    assert abs(fit["mu_q"] - 0.3) <= 0.11
    again = spins.resampled_couplings(nodes, edges, spark.createDataFrame([(seen,), (seen,), (0.0,)], "spin_sum double"), 6, [0.1, 0.2, 0.3, 0.4], draws=2)
    assert again.count() == 6 and {r["mu_q"] for r in again.collect()} <= {0.1, 0.2, 0.3, 0.4}


def test_zeros_from_patterns_fit_as_zeros_in_rows(spark):
    rng = random.Random(12)
    spots = [(i, rng.randrange(2), float(rng.randrange(6))) for i in range(120)]
    present = [(i, g, c) for i, grp, z in spots for g in "abc" if (c := rng.choice([0, 0, 1, 2, 7]) * (g != "c") + (g == "b") * grp + (i < 2)) > 0 or rng.random() < 0.1]
    groups = spark.createDataFrame(spots, "spot_id long, grp int, z double")
    rows = spark.createDataFrame(present, "spot_id long, gene string, cnt long").join(groups, "spot_id")
    full = groups.join(rows.select("gene").distinct()).join(rows.select("spot_id", "gene", "cnt"), ["spot_id", "gene"], "left").na.fill(0, ["cnt"])
    sparse = {r["gene"]: r for r in regress.nb_fit(rows, "cnt", ["z", "grp"], "gene", cells=groups).collect()}
    for r in regress.nb_fit(full, "cnt", ["z", "grp"], "gene").collect():
        own = sparse[r["gene"]]
        assert (own["n"], own["status"]) == (r["n"], r["status"]) == (120, "ok")
        assert np.allclose(own["beta"], r["beta"], atol=1e-6) and np.allclose(own["se"], r["se"], rtol=1e-5) and abs(own["theta"] / r["theta"] - 1) < 1e-4
    assert regress.nb_fit(rows.where("false"), "cnt", ["z", "grp"], "gene", cells=groups.where("false")).count() == 0


# ------------------------------------------------------------------- spatial


def test_expansion_from_the_middle(spark, lattice):
    region = lattice.where("spot_id in (16, 17, 23, 24)")
    rows = {i: (x, y) for i, x, y in grid(7, 7)}
    mx, my = (sum(rows[i][k] for i in (16, 17, 23, 24)) / 4 for k in (0, 1))
    taken = lattice.where("spot_id = 18")
    ring = {i: max(1, math.ceil(round(math.hypot(x - mx, y - my) - 1.4, 9))) for i, (x, y) in rows.items() if i not in (16, 17, 18, 23, 24)}
    for times in (1.0, 3.0, 100.0):
        stop = next((r for r in range(1, 20) if sum(v <= r for v in ring.values()) >= 4 * times), 99)
        got = {r["spot_id"]: r["ring"] for r in spatial.expanded_region(region, lattice, taken, 1.0, times).collect()}
        assert got == {i: v for i, v in ring.items() if v <= stop}


def test_neighbour_lines_are_lattice_lines(lattice):
    one = {frozenset(v) for v in _by_line(spatial.lines(lattice, 1.0)).values() if len(v) > 2}
    two = {frozenset(v) for v in _by_line(spatial.neighbour_lines(lattice, 1.2, 2)).values()}
    assert one == two and two


def _by_line(lines):
    found = {}
    for r in lines.collect():
        found.setdefault((r["direction"], r["line_id"]), []).append(r["spot_id"])
    return found


# --------------------------------------------------------------- regressions


def counted(rng, n, slope=0.4):
    x = rng.normal(3, 2, n)
    mu = np.exp(0.5 + slope * x)
    return x, rng.negative_binomial(3, 3 / (3 + mu))


def test_count_regression_is_the_kernels(spark):
    rng = np.random.default_rng(1)
    data = [("a", *v) for v in zip(*counted(rng, 300), strict=True)] + [("b", *v) for v in zip(*counted(rng, 80, -0.3), strict=True)] + [("zero", float(k), 0) for k in range(9)]
    df = spark.createDataFrame([(g, float(x), int(y)) for g, x, y in data], "gene string, x double, y long").repartition(5)
    fit = {r["gene"]: r for r in regress.nb_fit(df, "y", ["x"], "gene").collect()}
    assert fit["zero"]["status"] == "undetermined" and fit["zero"]["beta"] is None
    for g in "ab":
        x, y = (np.array([v[k] for v in data if v[0] == g], float) for k in (1, 2))
        want = nb_glm(y, np.column_stack([np.ones(len(x)), x]))
        assert np.allclose(fit[g]["beta"], want["beta"], atol=1e-5) and np.allclose(fit[g]["se"], want["se"], rtol=1e-3) and abs(fit[g]["theta"] / want["theta"] - 1) < 1e-3
    whole = df.where("gene = 'a'")
    got = sorted((r["x"], r["r"]) for r in regress.pearson_residuals(whole, regress.nb_fit(whole, "y", ["x"]), "y", ["x"], "r").collect())
    x, y = (np.array([v[k] for v in data if v[0] == "a"], float) for k in (1, 2))
    assert np.allclose([v for _, v in got], nb_glm(y, np.column_stack([np.ones(len(x)), x]))["resid"][np.argsort(x)], atol=1e-4)
    assert regress.nb_fit(df.where("false"), "y", ["x"], "gene").count() == 0


def test_mixed_models_are_the_kernels(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, spread in (("a", 2.0), ("b", 0.0)):
        for p in range(40):
            b = rng.normal(0, spread)
            rows += [(g, p, float(x), float(e := rng.normal()), float(1 + 0.3 * x - 0.5 * e + b + rng.normal())) for x in range(1, 3 + p % 5)]
    long = spark.createDataFrame(rows, "gene string, path_id long, x double, ex_score double, value double").repartition(4)
    fit = {r["gene"]: r for r in regress.mixed_fit(long, ["gene"], "path_id", "value", ["ex_score", "x"]).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        x, y, group = np.array([[1, r[3], r[2]] for r in own]), np.array([r[4] for r in own]), np.array([r[1] for r in own])
        beta, se, ratio = mixed_model(y, x, group)
        assert np.allclose(fit[g]["beta"], beta, atol=1e-5) and np.allclose(fit[g]["se"], se, atol=1e-5) and abs(fit[g]["ratio"] - ratio) < 1e-3 * max(ratio, 1)
    got = {(r["gene"], r["term"]): r for r in compare.mixed_trends(long, ["a", "b"]).collect()}
    f = (fit["a"]["beta"][2] / fit["a"]["se"][2]) ** 2
    assert abs(got["a", "x"]["f"] - f) < 1e-6 * f and abs(got["a", "x"]["p"] - f_p_value(f, 1, fit["a"]["n"] - 1)) < 1e-9
    # two stages: what the first leaves, by hand
    staged = {r["gene"]: r for r in compare.staged_trends(long, ["a", "b"]).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        y, group = np.array([r[4] for r in own]), np.array([r[1] for r in own])
        x = np.column_stack([np.ones(len(own)), [r[3] for r in own]])
        beta, _, ratio = mixed_model(y, x, group)
        e = y - x @ beta
        pull = {p: ratio * e[group == p].sum() / (1 + ratio * (group == p).sum()) for p in set(group.tolist())}
        beta, se, _ = mixed_model(e - np.array([pull[p] for p in group.tolist()]), np.column_stack([np.ones(len(own)), [r[2] for r in own]]), group)
        assert abs(staged[g]["beta"] - beta[1]) < 1e-4
    assert {r["gene"]: r["way"] for r in compare.trend_genes(compare.mixed_trends(long, ["a", "b"])).collect()} == {"a": "up", "b": "up"}


def test_stages_are_fitted_in_one_pass(spark):
    """The second model comes from the sums of the first one's groups, with nulls and groups of many sizes, and no window over the rows is left."""
    rng, rows = np.random.default_rng(3), []
    for g in "ab":
        for path in [None, *range(60)]:
            b = rng.normal()
            for x in range(1, 2 + rng.integers(1, 7)):
                e, hole = float(rng.normal()), rng.random()
                rows.append((g, path, None if hole < 0.05 else float(x), None if 0.05 < hole < 0.1 else e, None if 0.1 < hole < 0.15 else float(5 + 0.2 * x - 0.7 * e + b + rng.normal())))
    long = spark.createDataFrame(rows, "gene string, path_id long, x double, ex_score double, value double").repartition(3)
    first = regress.mixed_fit(long, ["gene"], "path_id", "value", ["ex_score"])
    left = regress.mixed_residuals(long, first, ["gene"], "path_id", "value", ["ex_score"], "rest")
    want = {r["gene"]: r for r in regress.mixed_fit(left, ["gene"], "path_id", "rest", ["x"]).collect()}
    found = regress.staged_fit(long, ["gene"], "path_id", "value", "ex_score", "x")
    got = {r["gene"]: r for r in found.collect()}
    assert set(got) == set(want) == {"a", "b"}
    for g, r in got.items():
        assert r["n"] == want[g]["n"] and np.allclose(r["beta"], want[g]["beta"], atol=1e-7) and np.allclose(r["se"], want[g]["se"], atol=1e-7)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert regress.staged_fit(long.where("false"), ["gene"], "path_id", "value", "ex_score", "x").count() == 0


def test_trends_make_the_long_table_once(spark):
    """Both mixed models read the long table once, however many passes they make over its rows."""
    rng = np.random.default_rng(9)
    rows = [(path, x, float(rng.integers(1, 9)), "a", float(rng.poisson(5) + x)) for path in range(12) for x in range(1, 5)]
    plain = spark.createDataFrame(rows, "path_id long, x int, ex_score double, gene string, value double")
    for model in (compare.mixed_trends, compare.staged_trends):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        assert model(plain.mapInPandas(count, plain.schema), ["a"]).count() > 0
        assert seen.value == len(rows), model.__name__


def test_linear_trend_p(spark):
    long = spark.createDataFrame([("A.1", float(x), float(v)) for x, v in ((1, 2), (2, 3), (3, 7), (4, 6), (5, 9))], "gene string, x double, value double")
    r = compare.linear_trends(long).first()
    assert r["gene"] == "A-1" and abs(r["p"] - t_p_value(r["t"], 3)) < 1e-12 and r["p"] == r["p_adj"]


def test_marker_correlations_p(spark):
    rng = random.Random(3)
    spots = spark.createDataFrame([(i,) for i in range(60)], "spot_id long")
    values = spark.createDataFrame([(i, g, float(v)) for i in range(60) for g in ("s", "t", "u") if (v := rng.randrange(4)) > 0], "spot_id long, gene string, value double")
    got = {r["gene"]: r for r in compare.marker_correlations(values, spots, ["s"]).collect()}
    assert got["s"]["rho"] == pytest.approx(1.0) and got["s"]["p"] < 1e-12
    assert got["t"]["p"] == pytest.approx(t_p_value(got["t"]["t"], 58))
    genes = trails.selected_genes(values, spots, ["s"], ["t", "u"], ["x"], least=-1.0, p_cut=1.1)
    assert genes == ["t", "u", "x"]


# ------------------------------------------------------------------ segments


def test_overlapping_pairs_are_not_shuffled(spark):
    """A pair of paths is counted where it meets first, so no exchange lies between the meeting and the result."""
    rng = np.random.default_rng(7)
    sets = {k: set(rng.choice(12, rng.integers(1, 7), replace=False).tolist()) for k in range(40)}
    table = spark.createDataFrame([(k, i, int(v)) for k, own in sets.items() for i, v in enumerate(sorted(own))], "path_id long, pos int, node long")
    for least in (0, 1, 3):
        found = paths.overlaps(table, least)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > least}
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want, least


def test_stretches_fit_as_alone():
    rng = np.random.default_rng(6)
    n = 24
    y = np.concatenate([rng.negative_binomial(4, 0.3, 12), rng.negative_binomial(4, 0.05, 12)])
    x = np.column_stack([np.ones(n), np.arange(1, n + 1), np.repeat([5.0, 5.0, 8.0, 2.0], 6)])
    for end in (2, 5, 13, 24):
        starts = [1, *range(3, end - 1)]
        beta, size, llh = nb_map_stretches(y, x, starts, end)
        for k, a in enumerate(starts):
            one = nb_map(y[a - 1 : end], x[a - 1 : end])
            assert np.allclose(beta[k], one[0], atol=2e-3) and abs(llh[k] - one[2]) < 1e-3 and abs(size[k] / one[1] - 1) < 1e-2, (a, end)


def test_pruning_keeps_the_best(spark):
    rng = np.random.default_rng(3)
    data = [(1, k + 1, int(v)) for k, v in enumerate(np.concatenate([rng.poisson(3, 15), rng.poisson(30, 15)]))] + [(2, k + 1, 4) for k in range(9)] + [(3, 1, 5)]
    points = spark.createDataFrame(data, "line_id long, pos int, y long")
    for method in ("gaussian", "nb"):
        one, two = (sorted(map(tuple, segments.segmented(points, [1.0], ["line_id"], method=method, prune=p).collect())) for p in (True, False))
        assert [r[:-1] for r in one] == [r[:-1] for r in two]
    assert {r["line_id"] for r in segments.segmented(points, [1.0], ["line_id"]).collect()} == {1, 2}
    first = [r for r in segments.segmented(points, [1.0], ["line_id"]).collect() if r["line_id"] == 1]
    assert any(r["start"] == 16 for r in first)
    costs = {(r["line_id"], r["start"], r["end"]): r for r in segments.stretch_costs(points, [0.5], ["line_id"]).collect()}
    y = np.array([v for i, _, v in data if i == 1])
    want = nb_map(y[3:12], np.column_stack([np.ones(30), np.arange(1, 31)])[3:12])[2]
    assert abs(costs[1, 4, 12]["neg2llh"] + 2 * want) < 1e-2 and costs[1, 4, 12]["cost"] == costs[1, 4, 12]["neg2llh"] + 3.0
    summary = {r["line_id"]: r for r in segments.segment_summary(segments.segmented(points, [1.0], ["line_id"]), ["line_id"]).collect()}
    assert sum(summary[1]["lengths"]) == 30 and summary[1]["n_changes"] == len(summary[1]["lengths"]) - 1


def test_lines_in_step_are_segmented_as_alone(spark):
    rng = np.random.default_rng(1)
    lines = sorted((rng.poisson(rng.choice([3, 30], size=n)).astype(float) for n in [2, 3, 4, 5, *rng.integers(6, 60, 12)]), key=len, reverse=True)
    penalties = np.array([0.6, 6.0, 300.0])
    for prune in (True, False):
        found = {}
        for p, k, _, a, b, total in sorted(zip(*(v.tolist() for v in segments.partitioned_lines(lines, penalties, prune)), strict=True)):
            found.setdefault((p, k), (total, []))[1].append((a, b))
        assert found == {(p, k): segments.partitioned(len(y), segments.gaussian_cost(y), penalties[p], prune) for p in range(3) for k, y in enumerate(lines)}
    long = rng.poisson(np.repeat([3, 30], 300)).astype(int).tolist()  # longer than what goes in step
    points = spark.createDataFrame([(k, i + 1, v) for k, y in enumerate([*lines, long]) for i, v in enumerate(map(int, y))], "line_id long, pos int, y long")
    got = sorted((r["line_id"], r["seg_no"], r["start"], r["end"]) for r in segments.segmented(points, [1.0], ["line_id"], method="gaussian").collect())
    whole = [*lines, np.array(long, float)]
    assert got == [(k, i + 1, a, b) for k, y in enumerate(whole) if len(y) >= 4 for i, (a, b) in enumerate(segments.partitioned(len(y), segments.gaussian_cost(y), 6.0)[1])]
    costs = {tuple(r)[:3]: r["neg2llh"] for r in segments.stretch_costs(points.where("line_id < 5"), [1.0], ["line_id"], method="gaussian").collect()}
    assert costs == {(k, a, b): segments.gaussian_cost(y)(np.array([a]), b)[0] for k, y in enumerate(lines[:5]) for b in range(2, len(y) + 1) for a in range(1, b)}


def test_count_lines_in_step_are_segmented_as_alone(monkeypatch):
    """Lines of counts share one fit an end, whatever the number of lines and penalties, and get the segments they get alone."""
    rng = np.random.default_rng(2)
    lines = [rng.negative_binomial(5, 5 / (5 + np.repeat([20, 200, 60], -(-n // 3))[:n])).astype(float) for n in (40, 31, 31, 12, 4, 2)]
    designs = [np.column_stack([np.ones(len(y)), np.arange(1, len(y) + 1), rng.integers(100, 400, len(y))]).astype(float) for y in lines]
    penalties, calls, fit = np.array([0.8, 4.0, 8.0]), [], segments.nb_map_many
    monkeypatch.setattr(segments, "nb_map_many", lambda *a, **k: calls.append(1) or fit(*a, **k))
    found = {}
    for p, k, _, a, b, total in sorted(zip(*(v.tolist() for v in segments.partitioned_lines(lines, penalties, True, designs)), strict=True)):
        found.setdefault((p, k), (total, []))[1].append((a, b))
    assert len(calls) == 39  # one an end
    for (p, k), (total, parts) in found.items():
        alone, own = segments.partitioned(len(lines[k]), segments.NbCosts(lines[k], designs[k]), penalties[p])
        assert parts == own and abs(total - alone) < 1e-6, (p, k)
    for a, b in ((1, 2), (3, 40), (17, 29)):
        one = nb_map(lines[0][a - 1 : b], designs[0][a - 1 : b])[2]
        assert abs(-2 * one - segments.NbCosts(lines[0], designs[0])(np.array([a]), b)[0]) < 1e-6


def test_estimates(spark):
    rng = np.random.default_rng(8)
    data = [(1, k + 1, int(v)) for k, v in enumerate(rng.negative_binomial(5, 0.2, 60))] + [(2, k + 1, 7) for k in range(10)]
    got = {r["method"]: r for r in segments.estimates(spark.createDataFrame(data, "line_id long, pos int, y long"), ["line_id"]).collect()}
    assert set(got) == {"nb", "glm", "pg"} and all(r["line_id"] == 1 and r["status"] == "ok" for r in got.values())
    assert got["pg"]["low"][0] < got["pg"]["beta"][0] < got["pg"]["high"][0] and abs(got["pg"]["beta"][0] - got["nb"]["beta"][0]) < 0.5
    y = np.array([v for i, _, v in data if i == 1], float)
    x = np.column_stack([np.ones(60), np.arange(1, 61)])
    assert abs(got["nb"]["llh"] - nb_loglik_logit(y, x @ np.array(got["nb"]["beta"]), got["nb"]["size"])) < 1e-6


def test_slopes_of_many_segments_are_fitted_in_step(spark, monkeypatch):
    """All segments of a task share one fit and get the slopes they get alone."""
    rng = np.random.default_rng(4)
    data = [(seg, k + 1, int(v), 0.0, float(rng.integers(100, 400))) for seg, n in enumerate([8, 8, 7, 3, 2, 8, 5]) for k, v in enumerate(rng.poisson(30, n) if seg != 5 else np.full(n, 9))]
    points = spark.createDataFrame(data, "seg int, pos int, y long, resid double, covar double").coalesce(1)
    monkeypatch.setattr(segments, "nb_estimates", None)
    got = {r["seg"]: (r["n"], r["slope"]) for r in segments.slopes(points, ["seg"], ["covar"]).collect()}
    for seg, (n, slope) in got.items():
        y, covar = (np.array([r[c] for r in data if r[0] == seg], float) for c in (2, 4))
        want = None if n < 3 else 0.0 if np.ptp(y) == 0 else nb_map(y, np.column_stack([np.ones(n), np.arange(1, n + 1), covar]))[0][1]
        assert len(y) == n and (slope is None if want is None else abs(slope - want) < 1e-8), seg


def test_slopes_take_residuals_of_all_spots(spark):
    data = [(1, k + 1, v, r) for k, (v, r) in enumerate([(2, 0.5), (4, -0.5), (9, 1.0), (20, 3.0)])] + [(2, 1, 5, 1.0), (2, 2, 5, 2.0), (2, 3, 5, 3.0)] + [(3, 1, 1, 9.0), (3, 2, 2, 9.0)]
    got = {r["seg"]: r for r in segments.slopes(spark.createDataFrame(data, "seg int, pos int, y long, resid double"), ["seg"]).collect()}
    assert got[1]["mean_resid"] == 1.0 and got[1]["slope"] > 0.3 and (got[2]["slope"], got[2]["mean_resid"]) == (0.0, 2.0) and got[3]["slope"] is None and got[3]["mean_resid"] is None


# --------------------------------------------------------------------- paths


def floyd(n, edges):
    d = [[0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        d[a][b] = min(d[a][b], w)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


def test_shortest_paths(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.randrange(1, 9) + 0.5) for a in range(25) for b in rng.sample(range(25), 3) if a != b]
    weight = {(a, b): w for a, b, w in edges}
    want = floyd(25, edges)
    graph_df = spark.createDataFrame(edges, "src long, dst long, weight double")
    asked = spark.createDataFrame([(a * 25 + b, a, b) for a in range(25) for b in range(25)], "path_id long, src long, dst long")
    got = {(r["src"], r["dst"]): r for r in graph.shortest_paths(asked, graph_df).collect()}
    assert set(got) == {(a, b) for a in range(25) for b in range(25) if want[a][b] < math.inf}
    for (a, b), r in got.items():
        assert r["cost"] == want[a][b] and r["nodes"][0] == a and r["nodes"][-1] == b and sum(weight[p] for p in zip(r["nodes"], r["nodes"][1:], strict=False)) == r["cost"]
    own = graph.shortest_paths(asked.withColumn("area", F.lit(1)), graph_df.withColumn("area", F.lit(2)), sample="area")
    assert {(r["src"], r["dst"]) for r in own.collect()} == {(a, a) for a in range(25)}


@pytest.mark.parametrize("placed", [True, False])
def test_equal_ways_have_one_answer(spark, placed):
    """Costs with many ties and edges of weight 0, over tiles of a few nodes: every node list as by the rule."""
    rng, n = random.Random(8), 6
    where = {a * n + b: (float(a), float(b)) for a in range(n) for b in range(n)}
    weight = {}
    for a, (x, y) in where.items():
        for b, (u, v) in where.items():
            if abs(x - u) + abs(y - v) == 1 and rng.random() < 0.9:
                weight[a, b] = rng.choice([0.0, 1.0, 1.0, 2.0])
    label = {}
    for s in where:
        best = {s: (0.0, 0)}
        for _ in where:
            for (a, b), w in weight.items():
                if a in best:
                    best[b] = min(best.get(b, (math.inf, 0)), (best[a][0] + w, best[a][1] + 1))
        label[s] = best
    def way(s, t):
        path = [t]
        while path[-1] != s:
            path.append(min(a for (a, b), w in weight.items() if b == path[-1] and a in label[s] and (label[s][a][0] + w, label[s][a][1] + 1) == label[s][b]))
        return path[::-1]
    asked = [(k, *rng.sample(sorted(where), 2)) for k in range(40)] + [(99, 3, 3)]
    places = spark.createDataFrame([(i, x, y) for i, (x, y) in where.items()], "spot_id long, x double, y double") if placed else None
    graph_df = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, weight double")
    found = graph.shortest_paths(spark.createDataFrame(asked, "path_id long, src long, dst long"), graph_df, places=places, side=2.0).collect()
    assert {r["path_id"]: (r["cost"], list(r["nodes"])) for r in found} == {k: (label[s][t][0], way(s, t)) for k, s, t in asked if t in label[s]}


def test_alternatives_share_no_node(spark, lattice):
    edges = spatial.neighbours(lattice, 1.2).withColumn("weight", F.col("d"))
    found = graph.shortest_paths(spark.createDataFrame([(1, 21, 27), (2, 0, 3)], "path_id long, src long, dst long"), edges)
    real = {r["path_id"]: list(r["nodes"]) for r in found.collect()}
    alts = {}
    for r in graph.alternative_paths(found, edges, lattice, 3.0).collect():
        alts.setdefault(r["path_id"], []).append(list(r["nodes"]))
    assert set(alts) == {1, 2}
    for i, own in alts.items():
        inner = [set(p[1:-1]) for p in [real[i], *own]]
        assert all(a[0] == real[i][0] and a[-1] == real[i][-1] for a in own) and sum(map(len, inner)) == len(set().union(*inner))
    more = {}
    for r in graph.second_alternatives(found.select("path_id", "nodes"), edges, lattice, 3.0).collect():
        more.setdefault(r["path_id"], []).append(list(r["nodes"]))
    for i, own in more.items():
        assert {tuple(p) for p in alts[i]} <= {tuple(p) for p in own} and len({tuple(p) for p in own}) == len(own)
        assert all(p[0] == real[i][0] and p[-1] == real[i][-1] and not set(p) & set(real[i][1:-1]) for p in own)
    assert len(more[1]) > len(alts[1])


def test_paths_up_a_gradient(spark, lattice):
    rows = grid(7, 7)
    nodes = lattice.withColumn("pt", F.col("x") * 2 + F.col("y") / 10)
    pt = {i: 2 * x + y / 10 for i, x, y in rows}
    found = trails.all_paths(nodes, 1.0, gap=1.5, line_cut=0.8, drop=0.5, least=4)
    values = sorted(pt.values())
    at = lambda q: float(np.quantile(values, q))
    place = {i: (x, y) for i, x, y in rows}
    dist = lambda a, b: math.hypot(place[a][0] - place[b][0], place[a][1] - place[b][1])
    edges = [(a, b, dist(a, b)) for a in pt for b in pt if a != b and dist(a, b) <= 1.3 and pt[b] >= pt[a]]
    want = floyd(49, edges)
    got = {(r["src"], r["dst"]): list(r["nodes"]) for r in found["space"].collect()}
    assert set(got) == {(a, b) for a in pt for b in pt if pt[a] <= at(1 / 3) and pt[b] - pt[a] > at(2 / 9) and dist(a, b) > 4 and want[a][b] < math.inf}
    assert all(abs(sum(dist(p, q) for p, q in zip(n, n[1:], strict=False)) - want[a][b]) < 1e-9 for (a, b), n in got.items())
    line = {(r["src"], r["dst"]): list(r["nodes"]) for r in found["line"].collect()}
    assert line and all(a in n and pt[n[-1]] >= pt[n[0]] and max(dist(p, q) for p, q in zip(n, n[1:], strict=False)) < 1.5 for (a, _), n in line.items())
    merged = trails.merged_paths(found)
    assert merged.count() == len({tuple(r["nodes"]) for df in found.values() for r in df.collect()})


@pytest.mark.parametrize("cut", [0.8, 3.0, 50.0])
def test_line_paths_need_no_table_of_lines_and_nodes(spark, lattice, monkeypatch, cut):
    """Paths near lines are those of the listed distances, and no table beyond the nodes is written for them, however wide the cut is."""
    rng = random.Random(4)
    pt = spark.createDataFrame([(i, 4 * x + rng.randrange(-3, 4)) for i, x, _ in grid(7, 7)], "spot_id long, pt double")
    nodes = lattice.select("spot_id", "x", "y").join(pt, "spot_id").localCheckpoint()
    starts, ends = trails.start_and_end_nodes(nodes)
    listed = trails.near_line_paths(trails.line_distances(nodes, starts, ends, 4.0, 2.0), cut, 1.0, 2.5, 4)
    plain = lambda df: sorted((r["src"], r["dst"], list(r["nodes"])) for r in df.collect())
    want = plain(listed)
    assert want and plain(trails.line_paths(nodes, starts, ends, 4.0, 2.0, cut, 1.0, 2.5, 4)) == want
    sizes, write = [], trails.written
    monkeypatch.setattr(trails, "written", lambda df: sizes.append(df.count()) or write(df))
    trails.all_paths(nodes, 1.0, gap=2.5, line_cut=cut, drop=1.0, least=4)["line"].collect()
    assert sizes and max(sizes) <= 49


def test_falls_are_taken_out():
    keep = lambda pt, drop, least=1: trails.rising(np.array(pt, float), drop, least).tolist()
    assert keep([1, 2, 3], 0.5) == [0, 1, 2]
    assert keep([1, 9, 2, 3], 0.5) == [0, 2, 3]
    assert keep([5, 1, 0.2, 3], 0.5) == [2, 3]
    assert keep([9, 8, 7, 6], 0.5, least=4) == [3]


def test_coherent_paths_by_hand(spark):
    genes = ["a", "b", "c"]
    profile = {1: (1, 2, 3), 2: (2, 4, 6), 3: (3, 2, 1), 4: (1, 3, 2), 5: (2, 3, 4), 6: (5, 1, 1)}
    values = spark.createDataFrame([(i, g, float(v)) for i, vs in profile.items() for g, v in zip(genes, vs, strict=True)], "spot_id long, gene string, value double")
    real = [(1, [1, 2, 5]), (2, [3, 6]), (3, [1, 2]), (4, [4, 6])]
    alt = [(1, [1, 4, 5]), (1, [1, 3, 5]), (2, [3, 1, 6]), (3, [1, 4, 2])]
    r = lambda p: float(np.mean([np.corrcoef(profile[a], profile[b])[0, 1] for a, b in zip(p, p[1:], strict=False)]))
    rated = [r(p) for _, p in alt]
    c75, c80, c90 = np.quantile(rated, [0.75, 0.8, 0.9])
    kept = {}
    for i, p in real:
        own = [r(q) for k, q in alt if k == i]
        good = r(p) > c90 if not own else r(p) > max(own) and r(p) > c75 and (len(own) > 1 or r(p) > c80)
        if good:
            kept[i] = p
    kept = {i: p for i, p in kept.items() if not any(j != i and set(p) <= set(q) and (len(q) > len(p) or j < i) for j, q in kept.items())}
    df = lambda rows: spark.createDataFrame(rows, "path_id long, nodes array<long>")
    got = {x["path_id"]: x for x in paths.coherent_paths(df(real), df(alt), values, genes).collect()}
    assert set(got) == set(kept) and 1 in kept and got[1]["r"] == pytest.approx(r([1, 2, 5])) and got[1]["n_alt"] == 2


def test_control_paths_avoid_real_ones(spark, lattice):
    nodes = lattice.withColumn("cluster", F.lit("a"))
    real = spark.createDataFrame([(1, [21, 22, 23, 24]), (2, [28, 29, 30, 31])], "path_id long, nodes array<long>")
    got = trails.control_paths(real, nodes, 1.0, wanted=400, sets=3).collect()
    assert len(got) == 6 and all(len(r["nodes"]) == 4 and not set(r["nodes"]) & {21, 22, 23, 24, 28, 29, 30, 31} for r in got)
    assert all(len({r["path_id"] for r in got if r["set_id"] == k}) == 2 for k in (1, 2, 3))


def test_overlaps_and_containment(spark):
    rng = random.Random(9)
    sets = {i: rng.sample(range(12), rng.randrange(1, 8)) for i in range(60)} | {100: [0, 1, 2], 101: [2, 1, 0], 102: [0]}
    df = spark.createDataFrame([(i, k, n) for i, ns in sets.items() for k, n in enumerate([*ns, ns[0]])], "path_id long, pos int, node long")
    for least in (0, 2):
        want = {(a, b, s) for a in sets for b in sets if a < b and (s := len({*sets[a]} & {*sets[b]})) > least}
        assert {tuple(r) for r in paths.overlaps(df, least).collect()} == want
    want = {a for a in sets if any(b != a and {*sets[a]} <= {*sets[b]} and (len(sets[b]) > len(sets[a]) or b < a) for b in sets)}
    assert {r["path_id"] for r in paths.contained(df).collect()} == want


def test_pairwise_quantile(spark):
    rng = random.Random(2)
    pts = [(i, rng.random() * 9, rng.random() * 9) for i in range(40)]
    d = sorted(round(math.dist(a[1:], b[1:]), 9) for a in pts for b in pts)
    df = spark.createDataFrame(pts, "spot_id long, x double, y double")
    for q in (0.01, 0.025, 0.026, 0.1, 0.7, 1.0):
        assert trails.pairwise_quantile(df, q, 0.1) == pytest.approx(np.quantile(d, q), abs=1e-8), q


# --------------------------------------------------------------- whole calls


def test_preparation(spark, sf):
    spots, counts = T.spots(spark, sf), T.counts(spark, sf)
    got = measures.prepared(spots, counts, ["NO", "RF"], ["AF", "NF"], least=60)
    n = got["cells"].count()
    assert 0 < n == got["nodes"].count() == got["members"].count() and got["spots"].where("ex_score is not null").count() == n
    assert got["cells"].agg(F.min("pt")).first()[0] == pytest.approx(0.0) and {r["gene"] for r in got["genes"].collect()} <= {"AF", "AO", "NF", "NO", "RF", "RO"}
    grouped = measures.prepared(spots, counts, ["NO", "RF"], ["AF", "NF"], least=60, grouping=(20.0, 10.0))
    assert grouped["nodes"].count() <= grouped["members"].count()


def test_sample_reader(spark, sf, tmp_path):
    counts = T.counts(spark, sf).select(F.col("spot_id").cast("string"), "gene", "cnt")
    counts.write.parquet(f"{tmp_path}/c.parquet")
    rows = T.spots(spark, sf).orderBy("spot_id").collect()
    with open(f"{tmp_path}/p.csv", "w") as f:
        f.write("barcode,in_tissue,array_row,array_col,pxl_row,pxl_col\n")
        f.writelines(f"{r['spot_id']},1,0,0,{r['x']},{r['y']}\n" for r in rows)
    got = T.read_sample(spark, f"{tmp_path}/c.parquet", f"{tmp_path}/p.csv", k=3, variable=4, components=2)
    assert got["genes"].count() == 4 and got["spots"].count() == counts.select("spot_id").distinct().count()
    assert len({r["cluster"] for r in got["spots"].collect()}) == 3 and got["norm"].count() == got["counts"].count()
    spark.createDataFrame([("t", "a"), ("t", "a"), ("t", None)], "list_name string, gene string").write.parquet(f"{tmp_path}/m.parquet")
    assert [tuple(r) for r in T.read_markers(spark, f"{tmp_path}/m.parquet").collect()] == [("t", "a")]


def test_coupling_data(spark, sf):
    got = region.coupling_data(T.spots(spark, sf), T.counts(spark, sf), ["AO", "RO"])
    e = got["energy"].first()
    assert got["states"].count() == got["spots"].count() and e["n_pairs"] == got["edges"].count() / 2 and -1 <= e["net_agreement"] <= 1


def test_distance_join_is_not_broadcast(spark, lattice):
    spots = T.written(lattice)
    near = spatial.pairs_within(spots, spots, 1.5)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() > 0


def test_surroundings_of_a_path():
    rng = np.random.default_rng(2)
    xy, reach = rng.uniform(-9, 9, (300, 2)), 2.5
    owners = {}
    for k, cell in enumerate(map(tuple, np.floor(xy / reach).astype(int).tolist())):
        owners.setdefault(cell, []).append(k)
    owners = {c: (np.array(k), xy[k, 0], xy[k, 1]) for c, k in owners.items()}
    steps = rng.uniform(-9, 9, (12, 2))
    near = (((xy[:, None] - steps) ** 2).sum(axis=2) <= reach * reach).any(axis=1)
    assert graph._near_steps(owners, steps[:, 0], steps[:, 1], reach) == set(np.flatnonzero(near).tolist())


def test_aimed_alternatives_are_the_plain_ones():
    """The aimed search opens fewer nodes and gives node for node what the plain one does, with ties, one-way edges and unplaced ends."""
    rng, opened, all_ = random.Random(1), 0, 0
    for trial in range(24):
        jitter = 0.3 if trial % 3 == 2 else 0.0
        at = {r * 12 + c: (r * math.sqrt(3) / 2 + rng.random() * jitter, c + 0.5 * (r % 2) + rng.random() * jitter) for r in range(12) for c in range(12)}
        weight = {(a, b): d * (1 if trial % 5 else 1 + rng.random()) for a in at for b in at if 0 < (d := math.dist(at[a], at[b])) <= 1.5}
        if trial % 2:
            weight = {k: w for k, w in weight.items() if rng.random() < 0.8}
        if trial % 4 == 0:  # a block holds the edges of a part of the nodes
            weight = {(a, b): w for (a, b), w in weight.items() if at[a][0] >= 2}
        a, b, w = (np.array(v) for v in zip(*((a, b, w) for (a, b), w in weight.items()), strict=True))
        place, pace = {n: at[n] for n in a.tolist()}, min(w / math.dist(at[a], at[b]) for (a, b), w in weight.items())
        plain, ways = graph._adjacency(pd.DataFrame({"src": a, "dst": b, "weight": w})), graph._ways(a, b, w)
        for _ in range(8):
            path, reach = rng.sample(sorted(at), rng.randrange(2, 5)), rng.choice([1.5, 3.0, 6.0])
            s, t = path[0], path[-1]
            held = {n for n, p in place.items() if any(math.dist(p, at[i]) <= reach for i in path)}
            aimed = graph._Aimed(ways, place, pace, [at[i] for i in path], True, reach, s, t)
            used = set(path) - {s, t}
            while True:
                dist, before = graph._tree(plain, s, t, used, held)
                want = graph._walk(before, s, t) if t in dist else None
                assert (None if aimed.shut_in(used) else aimed.path(used)) == want
                opened, all_ = opened + len(aimed.left), all_ + len(dist)
                if want is None or len(want) <= 2:
                    break
                used |= set(want[1:-1])
    assert opened < all_


def test_alternatives_deal_edges_by_cell(spark, lattice):
    edges = spatial.neighbours(lattice, 1.2).withColumn("weight", F.col("d"))
    paths = spark.createDataFrame([(k, [7 * r + 1 for r in range(7)]) for k in range(3)], "path_id long, nodes array<long>")
    plan = graph.alternative_paths(paths, edges, lattice, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsIn" in plan and "collect_list" not in plan  # no path carries its own copy of the edges


def test_pairwise_quantile_by_runs(spark):
    rng = np.random.default_rng(4)
    spots = [(x, y) for _, x, y in grid(6, 60)] + [(2.0, 0.7 * k) for k in range(30)] + [(float(a), float(b)) for a, b in rng.uniform(0, 9, (5, 2))] + [(0.0, 3.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "spot_id long, x double, y double")
    assert trails._runs(points).agg(F.sum("n")).first()[0] == len(spots)
    assert trails._runs(points).count() * 8 <= len(spots)
    xy = np.array(spots)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)).ravel()
    assert trails._run_distances(trails._runs(points), 5.0).agg(F.sum("n")).first()[0] == (np.round(d, 9) <= 5.0).sum()
    for share in (0.001, 0.02, 0.3, 1.0):
        assert abs(trails.pairwise_quantile(points, share, 1.0) - np.quantile(d, share)) < 1e-8, share


def test_gene_means_group_a_path_once(spark):
    steps = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 10), (2, 1, 12)], "path_id long, pos int, node long")
    counts = spark.createDataFrame([(10, "a", 4), (11, "a", 1), (11, "b", 6), (10, "z", 9)], "spot_id long, gene string, cnt long")
    found = paths.gene_means(steps, counts, ["a", "b"], ["path_id"])
    assert sorted(map(tuple, found.collect())) == [(1, "a", 3.0), (1, "b", 2.0), (2, "a", 0.0), (2, "b", 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_far_goal_leaves_most_nodes_alone(spark):
    """A search along a lattice line keeps to its first bucket, however many tiles and rounds it takes."""
    places = spark.createDataFrame([(60 * i + j, float(j), float(i)) for i in range(30) for j in range(60)], "spot_id long, x double, y double")
    edges = spatial.neighbours(places, 1.0).select("src", "dst", F.col("d").alias("weight"))
    asked = spark.createDataFrame([(15 * 60, 15 * 60 + 59)], "start long, goal long")
    assert graph._labels(graph._Tiles(edges, places, None, 6.0), asked, False).count() <= 400
    (found,) = graph.shortest_paths(asked.selectExpr("1 as path_id", "start as src", "goal as dst"), edges, places=places, side=6.0).collect()
    assert found["cost"] == 59.0 and found["nodes"] == list(range(15 * 60, 15 * 60 + 60))


def test_equal_paths_are_correlated_once(spark, monkeypatch):
    """An alternative of two paths, and one that is a path too, is one row for the correlations; arrays and maps of values give the same."""
    from lattica.operators import paths as P

    rows = [(n, g, c) for n, cs in {1: (5, 1, 0), 2: (9, 2, 1), 3: (0, 7, 2), 4: (4, 4, 9), 5: (1, 0, 6)}.items() for g, c in zip("abc", cs, strict=True) if c]
    values = spark.createDataFrame(rows, "spot_id long, gene string, value long")
    real = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, [5])], "path_id long, nodes array<long>")
    other = spark.createDataFrame([(1, [3, 4]), (2, [4, 5]), (1, [4, 5])], "path_id long, nodes array<long>")
    asked, plain = [], P.mean_correlations

    def seen(flat, *rest):
        asked.append(flat.select("path_id").distinct().count())
        return plain(flat, *rest)

    monkeypatch.setattr(P, "mean_correlations", seen)
    found = []
    for few in (64, 0):
        monkeypatch.setattr(P, "FEW", few)
        kept = P.coherent_paths(real, other, values, ["a", "b", "c"]).collect()
        found.append(sorted((r["path_id"], round(r["r"], 9), round(r["best"], 9), r["n_alt"]) for r in kept))
    assert asked == [4, 4] and found[0] == found[1] and [(f[0], f[3]) for f in found[0]] == [(1, 2)]


@pytest.mark.parametrize("name", ["q_strata_control", "q_compare_linked", "q_bonus"])
def test_line_items_are_grouped_once(spark, sf, name):
    """What is read several times of the line items is written, so the query's own plan does not group them again."""
    from lattica.plans import queries as Q

    assert "l_partkey" not in Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_large_paths_are_dealt_by_their_rows(spark, sf, monkeypatch):
    """Parts of paths and their gene means follow from the rows, not from the session's shuffle partitions alone; results stay."""
    from lattica.plans import queries as Q
    from lattica.sources import tables as T

    rows = lambda: sorted(map(str, Q.QUERIES["q_path_gene_mean"](spark, sf).collect()))
    before = rows()
    monkeypatch.setattr(T, "PART_ROWS", 700)
    parts = -(-T.table(spark, sf, "lineitem").count() // 700)
    assert parts > 4 and T.order_paths(spark, sf).rdd.getNumPartitions() == parts and rows() == before
