"""Region detection from counts and places to regions: the operators in their usual order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mixture import histogram, in_upper_part, two_parts
from ..operators import graph, measures, segments, spatial, spins
from ..sources.tables import written

#: Candidates of the first coupling: 0.16 to 0.44 by 0.01.
CANDIDATES = [round(0.16 + 0.01 * k, 2) for k in range(29)]


def signal_states(spots: DataFrame, counts: DataFrame, genes: list[str], adjust: bool = False) -> DataFrame:
    """``spot_id, s``: -1 for the part of a two-part normal mixture of the genes' counts with the higher mean; 1 for all where counts do not differ.

    One variance or two are chosen by the Bayesian information criterion.  With ``adjust``, counts are first freed of a spot's total count.
    """
    if adjust:
        own = measures.adjusted_counts(spots, counts, genes).select("spot_id", F.col("resid").alias("signal"))
    else:
        own = measures.marker_sums(spots, counts, {"signal": genes}).select("spot_id", F.col("signal").cast("double").alias("signal"))
    own = written(own)
    parts = two_parts(histogram(own, "signal"))
    if parts is None:
        return own.select("spot_id", F.lit(1).alias("s"))
    return own.select("spot_id", F.when(in_upper_part(F.col("signal"), parts), -1).otherwise(1).alias("s"))


def coupling_data(spots: DataFrame, counts: DataFrame, signal: list[str], adjust: bool = True) -> dict[str, DataFrame]:
    """``spots`` with a neighbour within 1.5 units, their ``edges``, ``states`` and ``energy`` (``n_pairs, spin_sum, net_agreement``)."""
    reach = 1.5 * spatial.unit_distance(spots)
    edges = written(spatial.neighbours(spots, reach))
    kept = spots.join(edges.select(F.col("src").alias("spot_id")).distinct(), "spot_id", "left_semi")
    states = written(signal_states(kept, counts, signal, adjust))
    return {"spots": kept, "edges": edges, "states": states, "energy": spins.energy(edges, states)}


def detect(
    spots: DataFrame,
    counts: DataFrame,
    exhaustion: list[str],
    surface: list[str],
    signal: list[str],
    area: DataFrame | None = None,
    alpha: float = 1.0,
    factors: tuple[float, ...] = (1.0, 3.25, 5.5, 7.75, 10.0),
    scan: tuple[int, int] = (1000, 500),
    sweeps: int = 5000,
    burn_in: int = 2000,
    draws: int = 10,
    max_gap: float = 7.0,
    least: int = 10,
    adjust: bool = False,
    seed: int = 1,
) -> dict[str, DataFrame]:
    """``states, lines, segments, slopes, bonus, curve, probability, regions`` of one tissue sample.

    The first coupling is the candidate of 0.16 to 0.44 whose chains meet the observed agreement best, the second
    is where the share of sure spots bends most over ``factors``, each tried with the sweeps and burn-in of ``scan``.
    """
    data = coupling_data(spots, counts, signal, adjust)
    spots, edges, states = written(data["spots"]), data["edges"], data["states"]
    observed = data["energy"].first()["spin_sum"] or 0.0
    spark, nodes = spots.sparkSession, spots.select("spot_id", "x", "y")
    fit = spins.fitted_coupling(nodes, edges, observed, CANDIDATES, draws, seed=seed)
    j1 = fit.agg(F.min_by("mu_q", F.struct("abs_g", "mu_q"))).first()[0]

    line_points = written(spatial.lines(spots, spatial.unit_distance(spots, 1.0), "hex", max_gap=max_gap))
    sums = measures.marker_sums(nodes.select("spot_id"), counts, {"y": exhaustion, "covar": surface})
    rested = written(measures.count_residual_score(sums, "y", "covar", "resid"))
    points = written(line_points.select("direction", "line_id", "pos", "spot_id").join(rested, "spot_id"))
    by = ["direction", "line_id"]
    segs = written(segments.segmented(points, [alpha], by, ["covar"]))
    inside = written(segments.sliced(points, segs, by))
    slope = written(segments.slopes(inside, [*by, "seg_no"], ["covar"]))

    sloped = inside.join(slope.select(*by, "seg_no", "slope"), [*by, "seg_no"]).select("spot_id", "direction", "slope")
    directed = edges.withColumn("direction", spatial.direction(F.col("dx"), F.col("dy")))
    bonus, regular = spins.end_bonus(spins.segment_ends(inside), directed, spins.steep_spots(sloped), spatial.line_margins(line_points))
    bonus, regular = written(bonus), written(regular.select("src", "dst"))

    tries = spark.createDataFrame([(i, float(j1), float(f)) for i, f in enumerate(factors)], "chain long, j double, factor double")
    sure = spins.gibbs(nodes, regular, bonus, tries, *scan, seed=seed).join(tries, "chain")
    curve = written(sure.groupBy("factor").agg((F.avg((F.col("prob") > 0.7).cast("double")) * 100).alias("percent")))
    j2 = spins.transition(curve).first()["factor"] or factors[0]
    last = spark.createDataFrame([(99, float(j1), float(j2))], "chain long, j double, factor double")
    probability = written(spins.gibbs(nodes, regular, bonus, last, sweeps, burn_in, seed=seed).select("spot_id", "prob"))
    regions = graph.regions(probability, edges, "prob", 0.9, least, area)
    return {"states": states, "lines": line_points, "segments": segs, "slopes": slope, "bonus": bonus, "curve": curve, "probability": probability, "regions": regions}
