"""What the registered queries share: the register, views of the driver's tables and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures, spatial
from ..sources import tables as T
from ..sources.tables import COUNTS_SQL, PATHS_SQL, SPOTS_SQL

#: Gene lists of the driver's tables that stand for exhaustion and surface markers.
EX, CELL = ["NO", "RF"], ["AF", "NF"]
GENES = ["AF", "AO", "NF", "NO", "RF", "RO"]
CORNERS = [(2.0, 2.0), (12.0, 4.0), (9.0, 11.0), (4.0, 9.0)]
REACH = 1.5

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; the SQL's doubles and the query's are rounded alike by the query itself."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = ("with " + ",".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def scored_spots(spark: SparkSession, sf: str) -> DataFrame:
    return measures.marker_sums(T.spots(spark, sf), T.counts(spark, sf), {"ex_sum": EX, "cell_sum": CELL})


SCORED = """
scored as (select s.*, coalesce(ex_sum, 0) as ex_sum, coalesce(cell_sum, 0) as cell_sum from spots s left join
  (select spot_id, cast(sum(case when gene in ('NO','RF') then cnt end) as bigint) as ex_sum, cast(sum(case when gene in ('AF','NF') then cnt end) as bigint) as cell_sum from counts group by 1) m using (spot_id))"""
EDGES = """
edges as (select a.spot_id as src, b.spot_id as dst, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) as d, b.x-a.x as dx, b.y-a.y as dy
  from spots a join spots b on a.spot_id <> b.spot_id and abs(a.x-b.x) <= 1.5 and abs(a.y-b.y) <= 1.5 where sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) <= 1.5)"""
STATES = """
states as (select spot_id, case when ex_sum > cell_sum then -1 else 1 end as s from scored)"""
S1, S2 = (SPOTS_SQL, COUNTS_SQL, SCORED), (SPOTS_SQL, COUNTS_SQL, SCORED, EDGES, STATES)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.neighbours(T.spots(spark, sf), REACH)


def states(spark: SparkSession, sf: str) -> DataFrame:
    return scored_spots(spark, sf).select("spot_id", F.when(F.col("ex_sum") > F.col("cell_sum"), -1).otherwise(1).alias("s"))


# --------------------------------------------------------------------- lines


def _lines_sql(parts: list[tuple[int, str, str]], gone: str, gap: float) -> tuple[str, str]:
    each = []
    for name, shared, along in parts:
        each.append(f"""select {name} as direction, spot_id, x, y, pos, dense_rank() over (order by island, run) as line_id from (
          select *, row_number() over (partition by island, run order by a, spot_id) as pos from (
          select *, count(*) over (partition by island, run) as n from (
          select *, sum(cut) over (partition by island order by a, spot_id rows unbounded preceding) as run from (
          select *, case when sqrt((x - lag(x) over w)*(x - lag(x) over w) + (y - lag(y) over w)*(y - lag(y) over w)) > {gap} then 1 else 0 end as cut from (
          select *, sum(brk) over (order by v, a, spot_id rows unbounded preceding) as island from (
          select spot_id, x, y, round({shared}, 6) as v, {along} as a, case when round({shared}, 6) - lag(round({shared}, 6)) over (order by round({shared}, 6), {along}, spot_id) >= 0.2 then 1 else 0 end as brk from spots where {gone}))
          window w as (partition by island order by a, spot_id)))) where n >= 2)""")
    return "lines as (" + " union all ".join(each) + ")", "select direction, cast(line_id as bigint) as line_id, cast(pos as integer) as pos, spot_id from lines"


_C, _S = math.cos(math.pi / 3), math.sin(math.pi / 3)
_C2, _S2 = math.cos(2 * math.pi / 3), math.sin(2 * math.pi / 3)
_HEX = [(30, f"(x*{_C!r} - y*{_S!r})", "y"), (90, "x", "y"), (150, f"(x*{_C2!r} - y*{_S2!r})", "y")]
HEX_LINES, ALL_LINES = _lines_sql(_HEX, "true", 10)
SQUARE_LINES, _ = _lines_sql([(90, "x", "y"), (0, "y", "x")], "true", 10)
GAP_LINES, _ = _lines_sql(_HEX, "spot_id in (select spot_id from scored where cell_sum >= 100)", 3.5)


def hex_lines(spark, sf, max_gap: float = 10.0):
    return spatial.lines(T.spots(spark, sf), 1.0, "hex", max_gap=max_gap)


MARGINS = """
margins as (select distinct spot_id from (select *, max(pos) over (partition by direction, line_id) as m from lines) where pos = 1 or pos = m)"""
LINE_SEGS = """
line_segs as (select direction, line_id, pos, spot_id, x, y, cast((pos - 1) // 8 as integer) + 1 as seg_no from lines),
ends as (select distinct spot_id, direction - o as direction from (select *, min(pos) over w as a, max(pos) over w as b from line_segs window w as (partition by direction, line_id, seg_no)), (values (0), (180)) t(o) where pos = a or pos = b)"""


def line_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut into stretches of eight spots."""
    return hex_lines(spark, sf).withColumn("seg_no", F.expr("cast((pos - 1) div 8 as int) + 1"))


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    """``spot_id, x, y, pt, cluster`` of all spots, the exhaustion sum as score."""
    return scored_spots(spark, sf).select("spot_id", "x", "y", F.col("ex_sum").cast("double").alias("pt"), "cluster")


def urgent(spark: SparkSession, sf: str) -> DataFrame:
    """``path_id, customer, month, real`` of all orders; urgent ones are the real paths, others the controls."""
    o = T.table(spark, sf, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return o.select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("customer"), month.cast("long").alias("month"), (F.col("o_orderpriority") == "1-URGENT").alias("real"))


URGENT = """
kinds as (select o_orderkey as path_id, o_custkey as customer, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as month, o_orderpriority = '1-URGENT' as "real" from orders)"""
PATHS = (COUNTS_SQL, PATHS_SQL)


def polygon_sql() -> str:
    """The spots inside ``CORNERS``."""
    hits = [f"(case when ({y1} > y) <> ({y2} > y) and x < {x1} + (y - {y1}) * {(x2 - x1) / (y2 - y1)!r} then 1 else 0 end)" for (x1, y1), (x2, y2) in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)]
    return f"select spot_id from spots where ({' + '.join(hits)}) % 2 = 1"
