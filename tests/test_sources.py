from pyspark.sql import functions as F

from lattica.sources import tables as T


def test_positions_drop_the_header(spark, tmp_path):
    path = tmp_path / "tissue_positions.csv"
    path.write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAA-1,1,0,0,10,20\nBB-1,1,0,1,30,40.5\n")
    assert [tuple(r) for r in T.read_positions(spark, str(path)).orderBy("spot_id").collect()] == [("AA-1", 10.0, 20.0), ("BB-1", 30.0, 40.5)]


def test_counts_and_sinks(spark, tmp_path):
    spark.createDataFrame([("AA-1", "g", 2), ("CC-1", "g", 1)], "spot_id string, gene string, cnt long").write.parquet(str(tmp_path / "c"))
    counts = T.read_counts(spark, str(tmp_path / "c"))
    spots = spark.createDataFrame([("AA-1", 1.0, 2.0), ("BB-1", 1.0, 3.0)], "spot_id string, x double, y double")
    c, s = T.aligned(counts, spots)
    assert [r["spot_id"] for r in c.collect()] == ["AA-1"] == [r["spot_id"] for r in s.collect()]
    T.save_barcodes(s, str(tmp_path / "b"))
    T.save_locations(s, str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "l"), header=True).columns == ["Barcode", "X", "Y"]
    assert spark.read.text(str(tmp_path / "b")).first()[0] == "AA-1"
    T.save_segments(spark.createDataFrame([(0.1, 1), (1.0, 2)], "alpha double, line_id long"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where(F.col("alpha") == 1.0).first()["line_id"] == 2


def test_clusters(spark):
    rows = [(i, g, float((i % 2) * 5 + k)) for i in range(12) for k, g in enumerate("abc")]
    norm = spark.createDataFrame(rows, "spot_id long, gene string, value double")
    got = {r["spot_id"]: r["cluster"] for r in T.spot_clusters(norm, list("abc"), 2, 2).collect()}
    assert len({got[i] for i in range(0, 12, 2)}) == 1 and got[0] != got[1]
