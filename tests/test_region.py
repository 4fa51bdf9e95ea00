from lattica.plans import region
from lattica.sources import tables as T


def test_detection_runs_end_to_end(spark, sf):
    spots, counts = T.spots(spark, sf), T.counts(spark, sf)
    got = region.detect(spots, counts, ["NO", "RF"], ["AF", "NF"], ["AO", "RO"], scan=(60, 20), sweeps=60, burn_in=20, draws=2, least=2)
    n = spots.count()
    assert got["states"].count() == n == got["probability"].count()
    assert all(0 <= r["prob"] <= 1 for r in got["probability"].collect())
    assert {r["direction"] for r in got["lines"].collect()} == {30, 90, 150}
    assert got["curve"].count() == 5
    sizes = [r["count"] for r in got["regions"].groupBy("region_id").count().collect()]
    assert all(s >= 2 for s in sizes)
