"""Sources, sinks and views: Visium-style inputs, and the same shapes built from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; a temporary one only on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # one machine and tests only
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write once to the folder all executors share (``spark.checkpoint.dir``) and read back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` wrote and nothing reads any more; other tables stay."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Have the driver's collector run: Spark deletes the shuffle files of finished jobs when their plans are collected there, and in a long chain of jobs they pile up until then."""
    spark._jvm.System.gc()


#: Rows of a part where a table is dealt by its size.
PART_ROWS = 500_000


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt by ``keys`` to parts of ``PART_ROWS``, so that a task does not grow with the table; as it is where the session's parts do.

    Groups by keys that are nearly unique are then made once, without partial ones of a whole split in front.
    """
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


# ------------------------------------------------------------- Visium inputs


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Long raw counts ``spot_id, gene, cnt`` from Parquet; zeros are implicit."""
    return spark.read.parquet(path).select(F.col("spot_id").cast("string"), F.col("gene").cast("string"), F.col("cnt").cast("long"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``spot_id, x, y`` from a tissue positions CSV, with or without a header line.

    Columns 1, 5 and 6 are used; a header line has no numbers there and drops out.
    """
    names = ["barcode", "in_tissue", "array_row", "array_col", "c5", "c6"]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return raw.select(F.col("barcode").alias("spot_id"), number("c5").alias("x"), number("c6").alias("y")).where("x is not null and y is not null")


def aligned(counts: DataFrame, positions: DataFrame, norm: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and spots that know each other; with normalised values, only their spots and genes."""
    if norm is not None:
        counts = counts.join(norm.select("spot_id").distinct(), "spot_id", "left_semi").join(norm.select("gene").distinct(), "gene", "left_semi")
    return counts.join(positions.select("spot_id"), "spot_id", "left_semi"), positions.join(counts.select("spot_id").distinct(), "spot_id", "left_semi")


def log_normalised(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """``spot_id, gene, value`` = log(1 + cnt / spot total * scale)."""
    total = counts.groupBy("spot_id").agg(F.sum("cnt").alias("total"))
    return counts.join(total, "spot_id").select("spot_id", "gene", F.log1p(F.col("cnt") / F.col("total") * scale).alias("value"))


def spot_clusters(norm: DataFrame, genes: list[str], k: int, components: int = 30, seed: int = 1) -> DataFrame:
    """``spot_id, cluster``: principal components and k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, VectorAssembler

    wide = norm.groupBy("spot_id").pivot("gene", genes).agg(F.first("value")).na.fill(0.0)
    data = VectorAssembler(inputCols=genes, outputCol="v").transform(wide)
    data = PCA(k=min(components, len(genes)), inputCol="v", outputCol="features").fit(data).transform(data)
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("spot_id", F.col("prediction").cast("string").alias("cluster"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker lists ``list_name, gene`` from a CSV with a header or from Parquet."""
    raw = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return raw.select(F.col("list_name").cast("string"), F.col("gene").cast("string")).dropna().distinct()


def read_sample(
    spark: SparkSession, counts_path: str, positions_path: str, k: int = 8, variable: int = 3000, components: int = 30, seed: int = 1,
    transform: str = "log", resolution: float = 0.3,
) -> dict[str, DataFrame]:
    """One capture area: ``counts``, ``norm``, ``genes`` (the ``variable`` most variable ones) and ``spots`` with total count and cluster.

    Counts and positions know each other's spots.  ``counts_path`` is Parquet, or a folder with ``matrix.mtx``, ``barcodes.tsv`` and ``features.tsv`` (or these
    gzipped) where it ends in a slash.  With ``transform`` "log", values are log-normalised and clusters are ``k``-means of principal components; with
    "stabilised", values are logarithms of counts corrected by the count regression, and clusters are groups of modularity ``resolution`` on the graph of
    the 20 nearest neighbours in the components of its residuals.
    """
    raw = read_counts(spark, counts_path) if not counts_path.endswith("/") else _matrix_counts(spark, counts_path)
    counts, positions = aligned(raw, read_positions(spark, positions_path))
    counts = written(counts)
    if transform == "stabilised":
        norm, genes, clusters = _stabilised(counts, variable, components, resolution, seed)
    elif transform == "log":
        norm = written(log_normalised(counts))
        n = positions.count()
        spread = norm.groupBy("gene").agg(((F.sum(F.col("value") * F.col("value")) - F.sum("value") * F.sum("value") / n) / max(n - 1, 1)).alias("v"))
        genes = spread.orderBy(F.desc("v"), "gene").limit(variable).select("gene")
        clusters = spot_clusters(norm, [r["gene"] for r in genes.collect()], k, components, seed)  # as many names as asked for
    else:
        raise ValueError(f"transform is log or stabilised, not {transform!r}")
    totals = counts.groupBy("spot_id").agg(F.sum("cnt").alias("total"))
    spots = positions.join(totals, "spot_id").join(clusters, "spot_id", "left")
    return {"counts": counts, "norm": norm, "genes": genes, "spots": spots}


def _matrix_counts(spark: SparkSession, folder: str) -> DataFrame:
    from .matrix import read_matrix

    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = {f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)}
    return read_matrix(spark, *[folder + (n if n in there else f"{n}.gz") for n in ("matrix.mtx", "barcodes.tsv", "features.tsv")])


def _stabilised(counts: DataFrame, variable: int, components: int, resolution: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``norm``, ``genes``, ``spot_id, cluster``) by the variance-stabilising transform and graph clusters."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators import communities, stabilise

    model = written(stabilise.stabiliser(counts))
    genes = stabilise.residual_variances(counts, model).orderBy(F.desc("variance"), "gene").limit(variable).select("gene")
    names = [r["gene"] for r in genes.collect()]  # as many as asked for
    vectors = written(stabilise.residual_vectors(counts, model, names)).select("spot_id", array_to_vector("v").alias("v"))
    reduced = PCA(k=min(components, len(names)), inputCol="v", outputCol="p").fit(vectors).transform(vectors)
    near = communities.nearest(reduced.select(F.col("spot_id").alias("id"), vector_to_array("p").alias("v")), 20)
    clusters = communities.graph_clusters(communities.shared_neighbours(near), vectors.select(F.col("spot_id").alias("id")), resolution, seed=seed)
    return stabilise.corrected(counts, model).select("spot_id", "gene", "value"), genes, clusters.select(F.col("id").alias("spot_id"), F.col("cluster").cast("string").alias("cluster"))


# --------------------------------------------------------------------- sinks


def save_segments(segments: DataFrame, path: str) -> None:
    """Segments as Parquet, one folder a penalty so that a reader of one penalty prunes the rest."""
    segments.write.mode("overwrite").partitionBy("alpha").parquet(path)


def save_barcodes(spots: DataFrame, path: str) -> None:
    """One barcode a line, no header."""
    spots.select("spot_id").write.mode("overwrite").csv(path, header=False)


def save_locations(spots: DataFrame, path: str) -> None:
    """Barcode, X and Y with a header."""
    spots.select(F.col("spot_id").alias("Barcode"), F.col("x").alias("X"), F.col("y").alias("Y")).write.mode("overwrite").csv(path, header=True)


# ------------------------------------------------- views on the driver tables


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangular lattice of parts: ``spot_id, cluster, p_size, x, y``."""
    part = table(spark, sf_dir, "part")
    w = part.agg(F.floor(F.sqrt(F.count(F.lit(1)))).alias("w"))
    row, col = F.expr("p_partkey div w"), F.expr("p_partkey % w")
    return part.join(F.broadcast(w)).select(F.col("p_partkey").alias("spot_id"), F.col("p_type").alias("cluster"), "p_size", (row * F.sqrt(F.lit(3.0)) / 2).alias("x"), (col + 0.5 * (row % 2)).alias("y"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spot_id, gene, cnt``: quantities of line items by part and flag pair."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("spot_id"), F.concat("l_returnflag", "l_linestatus").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("cnt"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, pos, y, covar``: a user's events in time order."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("line_id"), pos.alias("pos"), F.floor("value").cast("long").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("covar"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path_id, pos, node``: an order's parts by line number, each once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    first = in_parts(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("n", "l_partkey"))
    return first.select(F.col("l_orderkey").alias("path_id"), pos.alias("pos"), F.col("l_partkey").alias("node"))


SPOTS_SQL = """
spots as (select p_partkey as spot_id, p_type as cluster, p_size, (p_partkey // w) * sqrt(3) / 2 as x, (p_partkey % w) + 0.5 * ((p_partkey // w) % 2) as y
  from part, (select cast(floor(sqrt(count(*))) as bigint) as w from part))"""
COUNTS_SQL = """
counts as (select l_partkey as spot_id, l_returnflag || l_linestatus as gene, cast(sum(l_quantity) as bigint) as cnt from lineitem group by 1, 2)"""
SERIES_SQL = """
series as (select user_id as line_id, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as pos, cast(floor(value) as bigint) as y,
  cast(json_extract_string(props, '$.k') as double) as covar from events)"""
PATHS_SQL = """
paths as (select l_orderkey as path_id, cast(row_number() over (partition by l_orderkey order by n, l_partkey) as integer) as pos, l_partkey as node
  from (select l_orderkey, l_partkey, min(l_linenumber) as n from lineitem group by 1, 2))"""
