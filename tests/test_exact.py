"""Exact search: hand-computed cases, ties, rejects, and both plans against a plain loop."""

import numpy as np
import pytest

from vectide.errors import EngineError
from vectide.functions.vectors import COSINE, IP, L2
from vectide.operators import exact as X

SUBSET8 = [(0.0, 1.0), (0.0, -1.0), (1.0, 0.0), (-1.0, 0.0)] * 2


def base(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<float>")


def asked(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "query_id long, vec array<double>")


def ids(found):
    return [r["id"] for r in found.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("plan", [X.topk, X.topk_expr])
def test_ties_go_to_the_lower_id(spark, plan):
    assert ids(plan(base(spark, SUBSET8), asked(spark, [(0, 0)]), 3, L2)) == [0, 1, 2]
    for metric in (IP, COSINE):
        assert ids(plan(base(spark, SUBSET8), asked(spark, [(1, 0)]), 8, metric)) == [2, 6, 0, 1, 4, 5, 3, 7]


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_plans_agree_with_a_loop(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (200, 6)).astype(np.float32) + 0.5  # many ties
    q = rng.normal(size=(7, 6))
    d = {L2: ((q[:, None] - x[None]) ** 2).sum(2), IP: -(q @ x.T), COSINE: -(q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)}[metric]
    want = [np.lexsort((np.arange(200), np.round(r, 9).astype(np.float32)))[:10].tolist() for r in d]
    for plan in (X.topk, X.topk_expr):
        got = plan(base(spark, x), asked(spark, q), 10, metric).orderBy("query_id", "rank").collect()
        assert [[r["id"] for r in got if r["query_id"] == i] for i in range(7)] == want


def test_fewer_rows_than_k_and_none(spark):
    assert ids(X.topk(base(spark, [(1, 2)]), asked(spark, [(0, 0)]), 5)) == [0]
    assert ids(X.topk(base(spark, []), asked(spark, [(0, 0)]), 5)) == []
    assert ids(X.topk(base(spark, [(1, 2)]), asked(spark, []), 5)) == []


def test_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(X, "QUERY_BLOCK_BYTES", 40)
    assert ids(X.topk(base(spark, SUBSET8), asked(spark, [(0, 1), (0, -1), (1, 0), (-1, 0)]), 1)) == [0, 1, 2, 3]


def test_rejects(spark):
    for bad in (lambda: X.check_search(0), lambda: X.check_search(9, 8), lambda: X.check_subset([1, 1], 8), lambda: X.check_subset([2, 1], 8), lambda: X.check_subset([8], 8), lambda: X.topk(base(spark, SUBSET8), asked(spark, [(0, 0)]), 3, COSINE), lambda: X.topk(base(spark, SUBSET8), asked(spark, [(0, 0), (1,)]), 3), lambda: X.topk(base(spark, SUBSET8), asked(spark, [(float("nan"), 0)]), 3)):
        with pytest.raises(EngineError):
            bad()


def test_rescoring_keeps_the_order(spark):
    found = spark.createDataFrame([(0, 1, 3), (0, 2, 2)], "query_id long, rank int, id long")
    got = X.with_scores(found, base(spark, SUBSET8), asked(spark, [(1, 0)]), IP).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(3, -1.0), (2, 1.0)]
    assert ids(X.rerank(found, base(spark, SUBSET8), asked(spark, [(1, 0)]), 2, IP)) == [2, 3]


def test_self_neighbours_leave_the_row_out(spark):
    got = X.self_knn(base(spark, [(0,), (1,), (3,)]), 1).orderBy("query_id").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(0, 1), (1, 0), (2, 1)]


def test_scores_of_many_queries_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(8000, 4)), rng.normal(size=(3000, 4))
    b = pa.record_batch([pa.array(np.arange(8000)), pa.array(list(x))], ["id", "vec"])
    tracemalloc.start()
    out = list(X._best(L2, 5, (np.arange(3000), q))([b]))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(o.num_rows for o in out) == 15000 and most < 100e6  # the scores of all pairs alone are 192 MB


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_tiles_give_what_one_matrix_gives(monkeypatch, metric):
    """Ties, a zero vector and fewer rows than k in a tile; the best come from several batches."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x, q = rng.integers(-2, 3, (90, 3)).astype(float), rng.integers(1, 3, (11, 3)).astype(float)
    x[0] = 0
    batches = [pa.record_batch([pa.array(r), pa.array(list(x[r]))], ["id", "vec"]) for r in (np.arange(40), np.arange(40, 90))]
    with np.errstate(invalid="ignore"):
        d = {L2: ((q[:, None] - x[None]) ** 2).sum(2), IP: -(q @ x.T), COSINE: -(q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)}[metric].astype(np.float32)
    d[np.isnan(d)] = np.inf
    want = [(i, j) for i in range(11) for j in np.lexsort((np.arange(90), d[i]))[:7].tolist()]
    monkeypatch.setattr(X, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(X, "SCORES_AT_ONCE", 20)
    monkeypatch.setattr(X, "RESULTS_AT_ONCE", 3)
    out = list(X._best(metric, 7, (np.arange(11), q))(batches))
    assert [(i, j) for o in out for i, j in zip(o.column("query_id").to_pylist(), o.column("id").to_pylist(), strict=True)] == want


def test_a_pair_is_scored_once_and_norms_are_taken_by_row(spark):
    """What costs a pair: one inner product under the join, none of them for norms, and no second one to see whether there is a score."""
    import io
    from contextlib import redirect_stdout

    found = X.topk_expr(base(spark, [*SUBSET8, (0, 0)]), asked(spark, [(1, 0), (0, 2)]), 9, COSINE)
    assert len(ids(found)) == 16 and 8 not in ids(found)  # the zero row has no score
    with redirect_stdout(io.StringIO()) as out:
        found.explain("formatted")
    join = out.getvalue().split("BroadcastNestedLoopJoin\n")[-1].split("\n(")[0]
    pairs = next(x for x in out.getvalue().split("\n(") if "zip_with(q#" in x)
    assert "Join condition: None" in join and pairs.count("zip_with") == 1


def test_more_pairs_than_expressions_are_for_go_through_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(60, 5)), rng.normal(size=(4, 5))
    plan = lambda: X.topk_expr(base(spark, x), asked(spark, q), 6, COSINE)
    joined, want = plan(), ids(plan())
    monkeypatch.setattr(X, "EXPR_WORK", 4 * 60 * 5 - 1)
    assert ids(plan()) == want
    says = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in says(joined) and "MapInArrow" in says(plan())
