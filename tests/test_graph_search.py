"""Pruning, construction, the beam and calibration: hand-traced cases and recall against exact search."""

import numpy as np
import pytest

from vectide.errors import EngineError
from vectide.functions.vectors import COSINE, IP, L2
from vectide.index import GenerationSlot, Index, LabelFilter, LabelKey, LabelUpdate
from vectide.operators import beam as B, calibration as C, evaluation as E, graph as G


def test_prune_occludes_what_is_nearer_to_a_kept_one():
    x = np.array([[0.0], [1.0], [1.5], [-3.0]])
    d = lambda a, b: ((x[a][:, None] - x[b][None]) ** 2).sum(2)
    pool = np.array([1, 2, 3])
    dist = d([0], pool)[0]
    kept, occluded = G.robust_prune(pool, dist, d(pool, pool), 4, 1.2, 0)
    assert kept == [1, 3] and occluded == [2]  # 2: 2.25 / 0.25 > 1.2; 3 lies on the other side
    assert G.robust_prune(pool, dist, d(pool, pool), 4, 1.2, 0, saturate=True)[0] == [1, 3, 2]
    assert G.robust_prune(pool, dist, d(pool, pool), 1, 1.2, 0)[0] == [1]
    assert G.robust_prune(pool, dist, d(pool, pool), 4, 1.2, 0, deleted={1})[0] == [3]


def test_convergence_and_early_exit():
    c = B.Convergence(3, 0.5)
    assert [c.update(0) for _ in range(6)] == [False] * 5 + [True]
    assert [c.update(1), c.update(1), c.update(0)] == [True, False, False]
    e = B.EarlyExit(2)
    assert [e.should_exit(True, 0), e.should_exit(True, 1), e.should_exit(True, 0), e.should_exit(False, 0), e.should_exit(True, 0), e.should_exit(True, 0)] == [False, False, False, False, False, True]


def test_beam_orders_by_distance_then_id():
    b = B.Beam(3)
    for d, i in ((2.0, 5), (1.0, 9), (2.0, 4), (1.0, 9), (3.0, 1), (1.0, 2)):
        b.insert(d, i)
    assert b.items == [(1.0, 2), (1.0, 9), (2.0, 4)] and b.worst() == 2.0
    assert [b.next(), b.next(), b.next(), b.next()] == [2, 9, 4, None]


def chain(n):
    return B.SharedGraph(np.arange(n), [np.array([i + 1] if i + 1 < n else [], np.int32) for i in range(n)], [np.array([], np.int32)] * n, [np.array([], np.int32)] * n, 0)


def test_walk_on_a_chain():
    x = np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1, 0])
    beam, n = B.walk(chain(10), lambda at: x[at], B.Controls(2, 4, adaptive=False))
    assert [i for _, i in beam.items] == [9, 8, 7, 6] and n["visits"] == 9 and n["post_hops"] == 0
    events: list = []
    B.walk(chain(10), lambda at: x[at] * 0 + at, B.Controls(1, 2, threshold=0.9, early_exit_limit=2, window=1), trace=events)
    assert events[0]["type"] == "entry" and events[-1]["type"] in ("beam", "early_exit")


def test_calibration_gaps_on_a_chain():
    # rows 0 and 10 are nearest to the query; the walk goes down the chain one row a step
    x = np.array([1.0, *[i + 10.0 for i in range(1, 10)], 1.1, 30.0])
    steps, top = C.full_walk(chain(12), lambda at: np.abs(x[at] - 1.0), 12, 2)
    assert top == [0, 10] and [ids for _, ids in steps][9] == [10] and len(steps) == 12


def test_trace_statistics(spark):
    rows = [(0, i, i in (0, 3, 9), [100 + i] if i in (0, 3, 9) else [], [100, 103, 109] if not i else [], 12) for i in range(12)]
    t = spark.createDataFrame(rows, C.TRACE)
    gaps = sorted((r["kind"], r["gap"]) for r in C.useful_gaps(t).collect())
    assert gaps == [("tail", 3), ("useful", 3), ("useful", 6)]
    assert C.percentile(C.useful_gaps(t).where("kind = 'useful'"), "gap", 95).first()[0] == 6
    assert C.percentile(t.where("false"), "step", 95).first()[0] == 0
    assert C.threshold(C.smoothed_rates(C.rates(t), 5), 5).first()[0] == 0.15  # too short a curve


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    return rng.normal(size=(300, 16)).astype(np.float32)


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_recall_of_graph_search(spark, data, metric):
    index = Index.from_array(spark, data, metric=metric, graph=G.GraphConfig(degree=12, build_l=30))
    with pytest.raises(EngineError) as e:
        index.search(data[:2], k=5)
    assert e.value.code == "INVALID_STATE"
    index.calibrate(data[:40], k=5)
    found = index.search(data[:20], k=5, search_list_size=60, scores=True)
    true = index.search_exact(data[:20], k=5).toPandas().pivot(index="query_id", columns="rank", values="id").to_numpy()
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.ids.tolist(), true.tolist(), strict=True)]) >= 0.9
    if metric == L2:
        assert found.ids[:, 0].tolist() == list(range(20)) and np.allclose(found.scores[:, 0], 0)


@pytest.mark.parametrize("admission", ["l2-u16", "l2-kt", "pq-l2", "exact-f32"])
@pytest.mark.parametrize("prefilter", ["none", "jl", "jl-hadamard"])
def test_every_arm_finds_the_row_itself(data, admission, prefilter):
    edges, captured, entry = G.build_shard(data.astype(float), G.GraphConfig(degree=12, build_l=30))
    full = [np.array(e) for e in edges]
    g = B.SharedGraph(np.arange(300), full, [e[:7] for e in full], [np.array(sorted(c)[:8], int) for c in captured], entry)
    s = B.Stages(data, L2, B.resolve_cascade(B.CascadeConfig(prefilter, admission), L2, 16))
    hits = sum(int(B.answer(g, s, data[i].astype(float), B.Controls(5, 60, 0.1, 6))[0][0] == i) for i in range(30))
    assert hits >= 27


def test_u8_rows(spark, data):
    x = np.clip((data * 40 + 128), 0, 255).astype(np.uint8)
    index = Index.from_array(spark, x, graph=G.GraphConfig(degree=12, build_l=30))
    assert index.cascade.admission == "native-l2-u8"
    index.calibrate(x[:20], k=3)
    assert index.search(x[:5], k=3).ids[:, 0].tolist() == list(range(5))


def test_cascades():
    assert B.default_cascade(L2, 512).prefilter == "jl" and B.default_cascade("ip", 64).admission == "ip-i8"
    for bad in (B.CascadeConfig(admission="ip-i8"), B.CascadeConfig(prefilter="x"), B.CascadeConfig(rerank="cosine-f32"), B.CascadeConfig(admission="l2-u16", rerank="l2-u16")):
        with pytest.raises(EngineError):
            B.resolve_cascade(bad, L2, 64)
    for bad in ((0, 5, 9), (3, 2, 9), (10, 10, 9)):
        with pytest.raises(EngineError):
            B.check_controls(*bad)


def test_shards_make_one_graph(spark, data):
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "id long, vec array<float>")
    config = G.GraphConfig(degree=10, build_l=20, passes=1, shard_rows=120)
    graph = G.build(base, config)
    assert G.violations(graph, 300, 10, 16).count() == 0 and graph.count() == 300
    found = B.search_sharded(base, base.where("id < 5").selectExpr("id query_id", "vec"), B.Controls(3, 30, adaptive=False), L2, G.assign_shards(base, config), config)
    assert [r["id"] for r in found.where("rank = 1").orderBy("query_id").collect()] == list(range(5))


def test_insert_and_delete(spark, data):
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "id long, vec array<float>")
    config = G.GraphConfig(degree=10, build_l=20, passes=1)
    graph = G.insert(G.build(base.where("id < 280"), config), base.where("id < 280"), base.where("id >= 280"), config)
    assert graph.count() == 300
    g, x = B.shared_graph(base, graph, 0)
    s = B.Stages(x, L2, B.resolve_cascade(B.CascadeConfig(admission="exact-f32"), L2, 16))
    assert sum(int(B.answer(g, s, x[i].astype(float), B.Controls(1, 40, adaptive=False))[0][0] == i) for i in range(280, 300)) >= 18
    found = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 3, 7)], "query_id long, rank int, id long")
    left = G.suppress(found, spark.createDataFrame([(5,)], "id long"), 2).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in left] == [(1, 6), (2, 7)]


def test_invariants_are_checked(spark):
    g = spark.createDataFrame([(0, [0], [], []), (1, [2, 2], [], []), (2, [9], [], []), (3, [1], [], [])], G.SCHEMA)
    assert {r["problem"] for r in G.violations(g, 4, 5, 5).collect()} == {"self-edge", "duplicate edge", "id out of range"}


def test_trace_is_well_formed(spark, data):
    index = Index.from_array(spark, data, graph=G.GraphConfig(degree=12, build_l=30, passes=1))
    index.calibrate(data[:10], k=3)
    q = spark.createDataFrame([(0, data[0].tolist())], "query_id long, vec array<double>")
    t = index.trace(q, k=3, search_list_size=20).cache()
    assert E.trace_problems(t).count() == 0 and E.trace_page(t, 0, 0, 2).count() == 2
    assert E.matched_states(t, t).first()["shared_steps"] == t.where("type = 'expansion'").count()
    edges = G.edge_list(index.graph).selectExpr("node", "id", "0 position")
    assert E.position_contribution(t, edges).first()["admitted"] > 0


def test_save_open_labels_and_slot(spark, data, tmp_path):
    index = Index.from_array(spark, data[:100], graph=G.GraphConfig(degree=10, build_l=20, passes=1), external_ids=[1000 + i for i in range(100)])
    index.calibrate(data[:10], k=3)
    index.update_labels(0, [LabelUpdate(LabelKey("n", "a"), add=(3, 4, 5))])
    ref = index.save(str(tmp_path / "snap"))
    with pytest.raises(EngineError):
        index.save(str(tmp_path / "snap"))
    back = Index.open(spark, ref)
    assert back.label_revision == 1 and back.calibrated_ks == [3] and back.resolve_external_ids([1003]) == [3]
    a, b = index.search(data[:4], k=3), back.search(data[:4], k=3)
    assert (a.ids == b.ids).all() and (a.external_ids == b.external_ids).all() and a.external_ids[0, 0] == 1000
    f = back.search_filtered(data[:1], LabelFilter(any=(LabelKey("n", "a"),)), k=5)
    assert sorted(f.result.ids[0, :3].tolist()) == [3, 4, 5] and f.result.counts.tolist() == [3] and f.label_revision == 1
    bare = index.save(str(tmp_path / "bare"), include_base=False)
    assert Index.open(spark, bare, index.raw).label_revision == 1
    for wrong in (None, index.raw.where("id < 99"), index.raw.selectExpr("id", "transform(vec, x -> x + 1) vec")):
        with pytest.raises(EngineError):
            Index.open(spark, bare, wrong)
    with pytest.raises(EngineError) as e:
        Index(spark, index.raw, memory_budget_gib=1e-9)
    assert e.value.code == "RESOURCE_EXHAUSTED"
    assert Index(spark, index.raw, graph=index.config, cache_dir=str(tmp_path / "cache")).graph_source == "built"
    assert Index(spark, index.raw, graph=index.config, cache_dir=str(tmp_path / "cache")).graph_source == "cache"
    slot = GenerationSlot(index)
    assert slot.replace(back, (3,)) == 1
    with pytest.raises(EngineError):
        slot.replace(back, (7,))
    other = G.build(back.base, G.GraphConfig(degree=9, build_l=20, passes=1))
    other.write.mode("overwrite").parquet(str(tmp_path / "snap" / "graph"))
    with pytest.raises(EngineError) as e:
        Index.open(spark, ref)
    assert e.value.code == "CORRUPT"
    for part in (tmp_path / "snap" / "graph").glob("part-*.parquet"):
        part.write_bytes(part.read_bytes()[:-50])
    with pytest.raises(EngineError) as e:
        Index.open(spark, ref)
    assert e.value.code == "CORRUPT"


@pytest.mark.parametrize("metric", ["squared-l2", "cosine"])
def test_a_search_for_a_row_finds_it(metric):
    """Rows of very different lengths: a path to each is not enough, the walk of the row's own search must take it."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if metric == "squared-l2":
        x *= rng.integers(1, 11, size=(300, 1))
    config = G.GraphConfig(degree=8, build_l=16, passes=1)
    edges, _, entry = G.build_shard(x, config, metric)
    assert [i for i in range(300) if i not in G.greedy_search(x, edges, entry, x[i], 16, metric)[0]] == []
    assert all(len(e) <= 8 and len(set(e)) == len(e) and i not in e for i, e in enumerate(edges))
    graph = B.SharedGraph(np.arange(300), [np.array(e, np.int32) for e in edges], [], [], entry)
    stages = B.Stages(x.astype(np.float32), metric, B.CascadeConfig("none", "exact-f32", "l2-f32" if metric == "squared-l2" else "cosine-f32"))
    assert [int(B.answer(graph, stages, x[i], B.Controls(5, 24, adaptive=False))[0][0]) for i in range(300)] == list(range(300))


def test_equal_rows_fill_a_beam_and_the_build_ends():
    x = np.vstack([np.zeros((60, 4)), np.eye(4)])
    edges, _, entry = G.build_shard(x, G.GraphConfig(degree=6, build_l=8, passes=1))
    assert max(map(len, edges)) <= 6 and all(i in G.greedy_search(x, edges, entry, x[i], 8)[0] for i in range(60, 64))


def test_the_medoid_is_that_of_all_rows(spark):
    """Rows that a stride sample of 1024 would leave out decide; any row may win; ids need not be dense."""
    at = [10.0 if i % 2 == 0 and i < 2048 else 0.0 for i in range(2100)]
    rows = [(i, [v, 1.0]) for i, v in enumerate(at)]
    assert G.medoid_entry(spark.createDataFrame(rows, "id long, vec array<double>")).first()["id"] == 1
    x = np.random.default_rng(4).normal(size=(400, 5))
    sums = ((x[:, None] - x[None]) ** 2).sum((1, 2))
    odd = [(7 * i + 1_000_000, r.tolist()) for i, r in enumerate(x)]
    assert G.medoid_entry(spark.createDataFrame(odd, "id long, vec array<double>")).first()["id"] == 7 * int(np.argmin(sums)) + 1_000_000


@pytest.mark.parametrize("metric", [L2, IP, COSINE])
def test_recall_of_a_built_shard_without_structure(metric):
    """Vectors without directions that stand out, of ten lengths, and a group of near copies: what a narrow degree must still reach."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 64))
    x[1900:] = x[0] + 0.01 * rng.normal(size=(100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if metric != COSINE:
        x *= rng.integers(1, 11, size=(2000, 1))
    edges, _, entry = G.build_shard(x, G.GraphConfig(degree=16, build_l=40, passes=1), metric)
    assert {len(e) for e in edges} == {16} and all(i not in e and len(set(e)) == 16 for i, e in enumerate(edges))
    graph = B.SharedGraph(np.arange(2000), [np.array(e, np.int32) for e in edges], [], [], entry)
    stages = B.Stages(x.astype(np.float32), metric, B.CascadeConfig("none", "exact-f32", {L2: "l2-f32", IP: "ip-f32", COSINE: "cosine-f32"}[metric]))
    asked = [*range(0, 1900, 20), *range(1900, 2000, 10)]
    true = np.argsort(G.pair_distances(metric, x[asked], x), axis=1, kind="stable")[:, :10]
    found = [B.answer(graph, stages, x[i], B.Controls(10, 100, adaptive=False))[0] for i in asked]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 10 for a, b in zip(found, true, strict=True)]) >= 0.97


def test_shards_joined_into_one_graph_reach_and_find_every_row(spark, data):
    """Rows and edges that can be shared: the joined graph is settled from its own entry, by tasks, within its degree."""
    base = spark.createDataFrame([(3 * i, r.tolist()) for i, r in enumerate(data)], "id long, vec array<double>")
    config = G.GraphConfig(degree=8, build_l=20, passes=1, shard_rows=100)
    graph = G.build(base, config)
    assert graph.count() == 300 and G.violations(graph, 900, 8, 16).count() == 0
    shared, x = B.shared_graph(base, graph, G.medoid_entry(base).first()["id"])
    assert {len(e) for e in shared.full} == {8}
    stages = B.Stages(x, L2, B.CascadeConfig("none", "exact-f32", "l2-f32"))
    assert [int(B.answer(shared, stages, x[i].astype(float), B.Controls(1, 24, adaptive=False))[0][0]) for i in range(300)] == [3 * i for i in range(300)]
