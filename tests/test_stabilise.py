import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import measures, stabilise
from lattica.operators.regress import nb_fit
from lattica.sources import matrix, tables


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(3)
    depth = rng.uniform(0.5, 2.0, 120)
    y = {f"g{k}": rng.negative_binomial(5, 5 / (5 + depth * m)) for k, m in enumerate(np.geomspace(0.3, 20, 9))}
    rows = [(i, g, int(c)) for g, v in y.items() for i, c in enumerate(v) if c]
    return spark.createDataFrame(rows, "spot_id long, gene string, cnt long"), y


def by_hand(counts, y):
    """Depths and (mean, b0, b1, theta) of each gene: own fits, smoothed by plain sums at the grid's points."""
    genes = sorted(y)
    total = np.sum([y[g] for g in genes], axis=0)
    depth = np.log10(total)
    rows = counts.join(stabilise.depths(counts), "spot_id")
    fit = {r["gene"]: r for r in nb_fit(rows, "cnt", ["depth"], by="gene", cells=stabilise.depths(counts)).collect()}
    mean = np.array([math.exp(np.mean(np.log1p(y[g]))) - 1 for g in genes])
    at, own = np.log10(mean), np.array([[*fit[g]["beta"], math.log10(1 + m / fit[g]["theta"])] for g, m in zip(genes, mean, strict=True)])
    width = 3 * 1.06 * at.std() * len(genes) ** -0.2
    grid = np.linspace(at.min(), at.max(), stabilise.GRID)
    curve = []
    for g in grid:
        w = [math.exp(-0.5 * ((g - a) / width) ** 2) for a in at]
        curve.append([sum(a * b for a, b in zip(w, own[:, c], strict=True)) / sum(w) for c in range(3)])
    b0, b1, over = (np.interp(at, grid, np.array(curve)[:, c]) for c in range(3))
    return genes, depth, mean, b0, b1, mean / (10**over - 1)


def test_transform(drawn):
    counts, y = drawn
    model = stabilise.stabiliser(counts)
    genes, depth, mean, b0, b1, theta = by_hand(counts, y)
    got = {r["gene"]: r for r in model.collect()}
    for k, g in enumerate(genes):
        assert np.allclose([got[g][c] for c in ("mean", "b0", "b1", "theta")], [mean[k], b0[k], b1[k], theta[k]], rtol=1e-6)
    mu = np.exp(b0 + np.outer(depth, b1))
    mu0 = np.exp(b0 + np.median(depth) * b1)
    data = np.array([y[g] for g in genes]).T
    r = (data - mu) / np.sqrt(mu + mu**2 / theta)
    for row in stabilise.corrected(counts, model).collect():
        i, k = row["spot_id"], genes.index(row["gene"])
        want = max(np.round(mu0[k] + r[i, k] * math.sqrt(mu0[k] + mu0[k] ** 2 / theta[k])), 0)
        assert row["residual"] == pytest.approx(r[i, k], rel=1e-6) and abs(row["cnt"] - want) <= 0 and row["value"] == pytest.approx(math.log1p(want))
    variances = {v["gene"]: v["variance"] for v in stabilise.residual_variances(counts, model).collect()}
    clipped = np.clip(r, -math.sqrt(120), math.sqrt(120))
    assert np.allclose([variances[g] for g in genes], clipped.var(axis=0, ddof=1), rtol=1e-6)
    assert np.ptp(np.log([*variances.values()])) < np.ptp(np.log(data.var(axis=0)))  # variances follow the means less
    vectors = {v["spot_id"]: v["v"] for v in stabilise.residual_vectors(counts, model, [*genes, "none"]).collect()}
    assert np.allclose([vectors[i] for i in range(120)], np.column_stack([np.clip(r, -2, 2), np.zeros(120)]), rtol=1e-6)


def test_matrix_round_trip(spark, drawn, tmp_path):
    counts, _ = drawn
    matrix.save_matrix(counts, str(tmp_path))
    paths = [str(tmp_path / n) for n in ("matrix.mtx", "barcodes.tsv", "features.tsv")]
    rows = lambda df: sorted((str(r["spot_id"]), r["gene"], r["cnt"]) for r in df.collect())
    assert rows(matrix.read_matrix(spark, *paths)) == rows(counts)


def test_sample_by_transform_and_graph(spark, drawn, tmp_path):
    counts, y = drawn
    matrix.save_matrix(counts, str(tmp_path))
    (tmp_path / "p.csv").write_text("".join(f"{i},1,0,0,{i % 12},{i // 12}\n" for i in range(120)))
    found = tables.read_sample(spark, f"{tmp_path}/", str(tmp_path / "p.csv"), variable=6, components=4, transform="stabilised")
    spots = found["spots"].collect()
    assert len(spots) == 120 and all(r["cluster"] for r in spots) and 1 <= len({r["cluster"] for r in spots}) < 60
    assert found["genes"].count() == 6 and found["norm"].count() == counts.count()
    assert {int(r["spot_id"]): r["total"] for r in spots} == {i: int(sum(v[i] for v in y.values())) for i in range(120)}


def test_matrix_files(spark, tmp_path):
    with gzip.open(tmp_path / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%metadata\n3 2 4\n1 1 5\n3 2 4\n2 2 0\n2 1 1\n")
    (tmp_path / "barcodes.tsv").write_text("BB-1\nAA-1\n")
    (tmp_path / "features.tsv").write_text("E1\tCD3\tGene Expression\nE2\tCD3\tGene Expression\nE3\tCD8\tGene Expression\n")
    paths = [str(tmp_path / n) for n in ("matrix.mtx.gz", "barcodes.tsv", "features.tsv")]
    got = sorted(tuple(r) for r in matrix.read_matrix(spark, *paths).select("spot_id", "gene", "cnt").collect())
    assert got == [("AA-1", "CD8", 4), ("BB-1", "CD3", 6)]
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 2 4\n1 1 5\n")
    with pytest.raises(ValueError, match="1 entries, 4 expected"):
        matrix.read_matrix(spark, str(tmp_path / "bad.mtx"), *paths[1:])


def test_region_preparation(spark, drawn):
    counts, _ = drawn
    spots = spark.range(120).select(F.col("id").alias("spot_id"), (F.col("id") % 12).cast("double").alias("x"), F.floor(F.col("id") / 12).cast("double").alias("y"), F.lit("a").alias("cluster"))
    found = measures.region_prepared(spots, counts, ["g7"], ["g8"])
    assert found["unit"] == pytest.approx(1.02)
    both = measures.marker_sums(spots, counts, {"a": ["g7"], "b": ["g8"]})
    want = {r["spot_id"]: r["z"] for r in measures.count_residual_score(both, "a", "b", "z").collect()}
    got = {r["spot_id"]: r["ex_score_nb"] for r in found["spots"].collect()}
    assert len(got) == 120 and all(got[i] == pytest.approx(want[i]) for i in got) and {"ex_score", "ex_sum", "cell_sum"} <= set(found["spots"].columns)
