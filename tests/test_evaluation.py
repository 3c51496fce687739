"""Evaluation on small tables, and the registry's oracles on the smallest test data."""

import os

import pytest

from vectide.errors import EngineError
from vectide.operators import evaluation as E


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, id long")


def test_recall(spark):
    found, truth = ranked(spark, [(0, 1, 5), (0, 2, 6), (1, 1, 9)]), ranked(spark, [(0, 1, 6), (0, 2, 7), (1, 1, 9), (2, 1, 3)])
    get = lambda df: {r["query_id"]: r["recall"] for r in df.collect()}
    assert get(E.recall(found, truth, 2)) == {0: 0.5, 1: 1.0, 2: 0.0}
    assert get(E.recall(found, truth, 2, divide_by_k=True)) == {0: 0.5, 1: 0.5, 2: 0.0}
    assert get(E.distinct_recall(found, truth, 2)) == {0: 0.5}
    assert E.mean_recall(E.recall(found, truth.where("false"), 2)).first()[0] == 0.0


def test_frontier(spark):
    p = spark.createDataFrame([(0.8, 100.0), (0.9, 90.0), (0.9, 95.0), (0.95, 40.0), (0.85, 50.0)], "recall double, qps double")
    assert sorted(map(tuple, E.frontier(p).collect())) == [(0.8, 100.0), (0.9, 95.0), (0.95, 40.0)]
    assert E.qps_at(p, 0.9).first()[0] == 95.0 and abs(E.qps_at(p, 0.925).first()[0] - 67.5) < 1e-9
    assert E.qps_at(p, 0.99).first()[0] is None and E.qps_at(p, 0.5).first()[0] is None


def test_latency_refuses_an_hour(spark):
    with pytest.raises(EngineError):
        E.latency_summary(spark.createDataFrame([(3_600_000_000_001,)], "ns long"))


def test_early_exits(spark):
    hops = spark.createDataFrame([(0, i, a, c) for i, (a, c) in enumerate([(0, True), (1, True), (0, True), (0, False), (0, True), (0, True)])], "query_id long, step long, admitted int, converged boolean")
    assert E.early_exits(hops, 2).first()["exit_step"] == 5


def test_preflight():
    assert E.preflight(10, 4)["base"] == 160 and E.preflight(10, 4, budget_gib=1e-9)["exceeds_budget"]
    with pytest.raises(EngineError):
        E.preflight(0, 4)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["x1_topk_ip", "x2_filtered_search", "q1_l2_u8", "q6_q7_jl_sparse", "g6_zones", "a7_convergence", "c2_useful_gaps", "c5_threshold", "e11_cliffs"])
def test_oracles(spark, name):
    import duckdb

    from vectide.plans.catalog import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    shown = lambda rows: sorted(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert shown(df.select(*cols).collect()) == shown(c.sql(f"select {', '.join(cols)} from ({ORACLES[name]}) t").fetchall())
