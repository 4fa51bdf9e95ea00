"""Sparse matrices as MatrixMarket triplets beside lists of barcodes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers

_PLACE = ["_file", "_block", "_line"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and the columns that put lines in order: file, its split, and the line in it; a path is a file or a folder of parts."""
    raw = spark.read.text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def _listed(spark: SparkSession, path: str, name: Column, out: str) -> DataFrame:
    """``number, out``: the lines of a list, numbered from 1."""
    return row_numbers(_lines(spark, path).where("value <> ''"), _PLACE, "number").select("number", name.alias(out))


def read_matrix(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """Long raw counts ``spot_id, gene, cnt`` from triplets ``feature barcode count``, numbered from 1 as in the two lists.

    A path is a file, plain or gzipped, or a folder of parts in order; plain ones are read in splits.  A feature goes by its second column, the
    name, else by its id; counts of one barcode and name are added up.  Raises where the matrix is no general
    coordinate matrix or its triplets are not as many as its size line says; stored zeros drop out.
    """
    tabs = F.split("value", "\t")
    spots = _listed(spark, barcodes, F.trim(tabs[0]), "spot_id")
    genes = _listed(spark, features, F.coalesce(F.get(tabs, 1), tabs[0]), "gene")
    lines = _lines(spark, matrix)
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).select(F.min("value")).first()[0] or ""
    if "coordinate" not in head or "general" not in head or "pattern" in head:
        raise ValueError(f"{matrix}: a general coordinate matrix with values is expected, not {head!r}")
    rows = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = rows.agg(F.min(F.struct(*_PLACE, "value")).alias("s")).first()["s"]  # the size line is the first without a mark
    n = int(size["value"].split()[2])
    own = (F.col("_file") == size["_file"]) & (F.col("_block") == size["_block"]) & (F.col("_line") == size["_line"])
    part = F.split(F.trim("value"), r"\s+")
    triplets = rows.where(~own).select(part[0].cast("long").alias("f"), part[1].cast("long").alias("b"), part[2].cast("double").alias("v"))
    if (found := triplets.count()) != n:
        raise ValueError(f"{matrix}: {found} entries, {n} expected")
    known = triplets.where("v <> 0").join(genes, F.col("f") == genes["number"]).drop("number").join(spots, F.col("b") == spots["number"])
    return known.groupBy("spot_id", "gene").agg(F.sum("v").cast("long").alias("cnt"))


def save_matrix(counts: DataFrame, folder: str) -> None:
    """``counts`` as ``matrix.mtx``, ``barcodes.tsv`` and ``features.tsv`` under ``folder``, each a folder of parts in order; barcodes and features by name."""
    spark = counts.sparkSession
    own = counts.select(F.col("spot_id").cast("string"), F.col("gene").cast("string"), "cnt")
    spots = row_numbers(own.select("spot_id").distinct(), ["spot_id"], "b").drop("_part")
    genes = row_numbers(own.select("gene").distinct(), ["gene"], "f").drop("_part")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(df: DataFrame, number: str, line: Column, name: str) -> None:
        df.repartitionByRange(parts, number).sortWithinPartitions(number).select(line.alias("value")).write.mode("overwrite").text(f"{folder}/{name}")

    put(spots, "b", F.col("spot_id"), "barcodes.tsv")
    put(genes, "f", F.concat_ws("\t", "gene", "gene", F.lit("Gene Expression")), "features.tsv")
    triplets = own.where("cnt <> 0").join(genes, "gene").join(spots, "spot_id").select(F.concat_ws(" ", "f", "b", "cnt").alias("value"))
    size = f"{genes.count()} {spots.count()} {own.where('cnt <> 0').count()}"
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general\n" + size,)], "value string").coalesce(1)
    head.unionByName(triplets).write.mode("overwrite").text(f"{folder}/matrix.mtx")  # the first part begins with the head
