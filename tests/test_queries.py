"""Every registered query with SQL against DuckDB; the others run and repeat."""

import math
import os

import duckdb
import pytest

from lattica.plans import queries as Q

#: Their chains and fits have tests of their own; here they run once.
SLOW = {"q_gibbs", "q_j1", "q_j1_resampled", "q_j2", "q_nb_segments", "q_nb_estimates", "q_path_selection", "q_graph_clusters"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    cur = duck.execute(Q.SQL[name])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs_and_repeats(spark, sf, name):
    found = [sorted(map(str, Q.QUERIES[name](spark, sf).collect())) for _ in range(1 if name in SLOW else 2)]
    assert found[0] and found[0] == found[-1]
