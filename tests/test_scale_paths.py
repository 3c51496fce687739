import io

import numpy as np
import pytest

from vectide.errors import EngineError
from vectide.functions.vectors import COSINE, IP, L2
from vectide.index import GraphConfig, Index
from vectide.operators import beam as B, evaluation as E, exact as X, graph as G
from vectide.sources import store
from vectide.sources.vecfiles import convert, read_vectors, write_vectors
from vectide.streaming.queries import piped_queries


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(8).normal(size=(300, 12)).astype(np.float32)


def rows(spark, x, key="id"):
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], f"{key} long, vec array<double>")


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_more_queries_than_a_block(spark, x, monkeypatch, metric):
    """Beyond one block, queries and rows meet in a grid of tasks, with the same result."""
    base, asked = rows(spark, x), rows(spark, x[:90], "query_id")
    found = lambda: sorted(tuple(r) for r in X.topk(base, asked, 7, metric).select("query_id", "rank", "id").collect())
    want = found()
    monkeypatch.setattr(X, "QUERY_BLOCK_BYTES", 2000)
    assert found() == want
    assert sorted(tuple(r) for r in X.topk_expr(base, asked, 7, metric).select("query_id", "rank", "id").collect()) == want


def test_grid_refuses_bad_queries(spark, x, monkeypatch):
    monkeypatch.setattr(X, "QUERY_BLOCK_BYTES", 16)
    for bad in ([float("nan")] * 12, None, [1.0]):
        asked = rows(spark, x[:3], "query_id").union(spark.createDataFrame([(9, bad)], "query_id long, vec array<double>"))
        with pytest.raises(EngineError):
            X.topk(rows(spark, x), asked, 3).collect()


def test_an_index_too_large_to_share_is_searched_by_shards(spark, x, monkeypatch):
    monkeypatch.setattr(B, "SHARED_BYTES", 1000)
    index = Index(spark, rows(spark, x), L2, GraphConfig(degree=8, build_l=24, passes=1, shard_rows=110))
    assert index.by_shards
    index.calibrate(x[:20], k=5)
    found = index.search(x[:30], k=5, search_list_size=40)
    truth = index.search_exact(x[:30], k=5).toPandas().groupby("query_id")["id"].apply(set)
    assert np.mean([len(set(found.ids[i].tolist()) & truth[i]) / 5 for i in range(30)]) >= 0.9
    with pytest.raises(EngineError):
        index.save("/tmp/never")


def test_sampled_distances_give_up_only_beyond_the_bound(x):
    rng = np.random.default_rng(1)
    wide, q = rng.normal(size=(400, 256)), rng.normal(size=256)
    d = ((wide - q) ** 2).sum(1)
    s = B.Sampled(wide, q)
    every = np.arange(400)
    assert np.allclose(s(every), d)
    bound = float(np.median(d))
    got = s(every, bound)
    assert (got[d >= bound] == np.inf).all() and np.allclose(got[np.isfinite(got)], d[np.isfinite(got)]) and np.isfinite(got[d < bound]).mean() > 0.95


def test_every_node_is_reached():
    """Far groups and one pass: all nodes have a path from the entry, within their degree."""
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(size=(60, 4)) * 0.1 + c for c in rng.normal(size=(6, 4)) * 50])
    edges, _, entry = G.build_shard(y, GraphConfig(degree=6, build_l=12, passes=1))
    seen, front = {entry}, [entry]
    while front:
        front = [j for i in front for j in edges[i] if j not in seen and not seen.add(j)]
    assert len(seen) == len(y) and max(map(len, edges)) <= 6 and all(len(set(e)) == len(e) and i not in e for i, e in enumerate(edges))


def test_queries_from_a_pipe(spark, x):
    raw = b"".join(np.array([12], "<u4").tobytes() + v.tobytes() for v in x[:25])
    batches = [b.collect() for b in piped_queries(spark, io.BytesIO(raw), batch=10)]
    assert [len(b) for b in batches] == [10, 10, 5] and [r["query_id"] for b in batches for r in b] == list(range(25))
    assert np.allclose([r["vec"] for b in batches for r in b], x[:25])
    for broken in (raw[:-1], raw[:2], raw + np.array([3, 0, 0, 0], "<u4").tobytes()):
        with pytest.raises(EngineError):
            list(piped_queries(spark, io.BytesIO(broken)))


def test_files_by_another_path(spark, x, tmp_path):
    """Paths with a scheme, and a conversion that pads."""
    path = f"file://{tmp_path}/a.fvecs"
    write_vectors(path, x, spark=spark)
    assert read_vectors(spark, path).count() == 300 and store.size(spark, path) == 300 * 52
    convert(spark, path, f"file://{tmp_path}/b.fbin", block=8)
    got = read_vectors(spark, f"file://{tmp_path}/b.fbin").orderBy("id").toPandas()["vec"]
    assert np.array_equal(np.stack(got.to_numpy()), np.pad(x, ((0, 0), (0, 4))))
    with pytest.raises(FileExistsError):
        write_vectors(path, x, spark=spark)


def test_profiles(spark, x):
    base = rows(spark, x)
    shared, m = B.shared_graph(base, G.build(base, GraphConfig(degree=8, build_l=24, passes=1)), 0)
    asked = base.where("id < 20").selectExpr("id AS query_id", "vec")
    stages = B.Stages(m, L2, B.CascadeConfig("none", "exact-f32", "l2-f32"))
    told = {p["name"]: p for p in E.profile(lambda c: B.search(asked, shared, stages, c), E.ablations(B.Controls(5, 40)), X.topk(base, asked, 5), 5)}
    assert set(told) == {"plain", "full", "local-extra", "local", "prefix"} and told["plain"]["recall"] >= 0.9 and told["local"]["visits"] <= told["plain"]["visits"]
