"""More queries over the test tables: sources and sinks, limits, traces, and searches whose result is a checked statement.

Where a result depends on a built graph or a fitted model, the query gives back what must hold of it (a recall reached, an
invariant kept), and its SQL says that it holds.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectide.errors import EngineError
from vectide.functions import vectors as V
from vectide.functions.vectors import COSINE, IP, L2
from vectide.operators import beam as B, calibration as C, evaluation as E, exact as X, graph as G, ivf, labels as L, quantizers as Q
from vectide.plans import catalog as K
from vectide.plans.catalog import asked, dot, embeddings, l2
from vectide.session import work_folder

QUERIES, ORACLES = {}, {}


def query(sql: str, ctes: str = K.SQL):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {ctes}{sql}"
        return f

    return add


def refused(f, code: str) -> bool:
    try:
        f()
    except EngineError as e:
        return e.code == code
    return False


def said(spark: SparkSession, rows: list[tuple[str, bool]]) -> DataFrame:
    return spark.createDataFrame([(name, bool(ok)) for name, ok in rows], "statement string, holds boolean")


def all_hold(*names: str) -> str:
    return " SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in names) + ") t(statement, holds)"


CHECKSUM = "round(list_sum(list_transform(list_zip(range(1, 65), {v}), lambda z: z[1] * z[2])), 3)"


def checksum(v: str):
    return F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)


# --- sources and sinks ---------------------------------------------------------------------------------------------------


def written(spark, d, kind: str, column: str = "unit") -> tuple[str, DataFrame]:
    from vectide.sources.vecfiles import write_vectors

    rows = embeddings(spark, d).orderBy("id").select(column).toPandas()[column]  # a test table, written as one small file
    path = f"{work_folder(spark)}/base.{kind}"
    write_vectors(path, np.stack(rows.to_numpy()), kind, spark=spark)
    return path, spark


for _kind, _column in (("fvecs", "unit"), ("bvecs", "u8"), ("fbin", "unit"), ("u8bin", "u8"), ("f16bin", "unit")):

    def _read(spark, d, kind=_kind, column=_column):
        from vectide.sources.vecfiles import read_vectors

        path, _ = written(spark, d, kind, column)
        places = 1 if kind == "f16bin" else 3
        return read_vectors(spark, path, kind).select("id", F.round(checksum("vec"), places).alias("checksum"))

    _read.__name__ = f"{'s1' if _kind.endswith('vecs') else 's2'}_{_kind}"
    _value = CHECKSUM.format(v="list_transform(unit, lambda x: x::FLOAT::DOUBLE)" if _column == "unit" else "u8")
    if _kind != "f16bin":
        query(f" SELECT id, {_value} AS checksum FROM e")(_read)

        def _limited(spark, d, kind=_kind, column=_column):
            from vectide.sources.vecfiles import read_vectors

            path, _ = written(spark, d, kind, column)
            return read_vectors(spark, path, kind, max_points=100).select("id", checksum("vec").alias("checksum"))

        if _kind in ("fvecs", "u8bin"):
            _limited.__name__ = f"s5_first_points_{_kind}"
            query(f" SELECT id, {_value} AS checksum FROM e WHERE id < 100")(_limited)


@query(f" SELECT id, round({l2('unit', 'list_transform(unit, lambda x: x::FLOAT)')}, 3) = 0 AS near FROM e")
def d7_half_precision(spark, d):
    """A file of half precision is within rounding of the table."""
    from vectide.sources.vecfiles import read_vectors

    path, _ = written(spark, d, "f16bin")
    half = read_vectors(spark, path, "f16bin").join(embeddings(spark, d).select("id", "unit"), "id")
    return half.select("id", (F.round(V.squared_l2(F.col("vec").cast("array<double>"), "unit"), 3) == 0).alias("near"))


@query(K.topk_sql(L2, 10).replace("rank, id, round(score, 4) AS score", "rank, id"))
def s7_ground_truth(spark, d):
    """Truth written as ivecs and read back, checked on the way."""
    from vectide.sources.vecfiles import ground_truth, read_vectors, write_vectors

    e = embeddings(spark, d)
    found = X.topk(e.select("id", "vec"), asked(e), 10, L2).orderBy("query_id", "rank").toPandas()
    path = f"{work_folder(spark)}/truth.ivecs"
    write_vectors(path, found["id"].to_numpy().reshape(-1, 10), "ivecs", spark=spark)
    truth = ground_truth(read_vectors(spark, path, "ivecs"), 10, e.count())
    return truth.select((F.col("query_id") * 100).alias("query_id"), F.col("rank").cast("long").alias("rank"), "id")


@query(K.topk_sql(IP, 3).replace("rank, id, round(score, 4) AS score", "rank, id"))
def s8_json_lines(spark, d):
    """Results written as JSON lines and read back; a second write is refused."""
    from vectide.sources.sinks import write_results

    e = embeddings(spark, d)
    found = X.topk(e.select("id", "vec"), asked(e), 3, IP)
    path = f"{work_folder(spark)}/results"
    write_results(found, path)
    back = spark.read.json(path).select("query_id", F.posexplode("ids").alias("p", "id"))
    return back.select("query_id", (F.col("p") + 1).cast("long").alias("rank"), "id")


@query(K.RANKED + " SELECT count(*) AS queries, round(avg(hits / least(n, 10)), 6) AS mean_recall, round(count(*) / 2.0, 6) AS qps FROM h")
def s9_run_summary(spark, d):
    out = E.run_summary(E.recall(*K.two_rankings(spark, d), 10), 2.0)
    return out.select("queries", F.round("mean_recall", 6).alias("mean_recall"), F.round("qps", 6).alias("qps"))


EDGES = ", " + K.SELF_KNN + ", g AS (SELECT node, id, dist, rank % 3 <> 0 AS original FROM knn), p AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dist, id) AS r, sum(original::INT) OVER (PARTITION BY node) AS deg FROM g), z AS (SELECT node, id, CASE WHEN r <= floor(0.6 * deg + 0.5) AND original THEN 'local' WHEN original THEN 'remote' WHEN r <= floor(0.6 * deg + 0.5) THEN 'extra' END AS zone FROM p)"


def zoned(spark, d) -> DataFrame:
    g = G.zones(K.knn(embeddings(spark, d)).withColumn("original", F.col("rank") % 3 != 0))
    return g


def zone_rows(g: DataFrame) -> DataFrame:
    return g.select("node", F.explode(F.create_map(F.lit("local"), F.col("local"), F.lit("remote"), F.col("remote"), F.lit("extra"), F.col("extra"))).alias("zone", "ids")).select("node", "zone", F.explode("ids").alias("id"))


for _version in (3, 4):

    def _staged(spark, d, version=_version):
        from vectide.sources.staged import read_staged, write_staged

        path = f"{work_folder(spark)}/graph.stag"
        write_staged(path, zoned(spark, d), 0, {"made_by": "a check"} if version == 4 else None)
        return zone_rows(read_staged(spark, path)[0])

    _staged.__name__ = f"s10_staged_v{_version}"
    query(EDGES + " SELECT node, zone, id FROM z WHERE zone IS NOT NULL")(_staged)


@query(" SELECT id, len(unit) + (48 - len(unit) % 48) % 48 AS size, " + CHECKSUM.format(v="unit") + " AS checksum FROM e")
def s11_zero_pad(spark, d):
    from vectide.sources.vecfiles import zero_pad

    return zero_pad(embeddings(spark, d).select("id", F.col("unit").alias("vec")), 48).select("id", F.size("vec").cast("long").alias("size"), checksum("vec").alias("checksum"))


@query(f" SELECT id, {CHECKSUM.format(v='list_transform(unit, lambda x: x::FLOAT::DOUBLE)')} AS checksum FROM e")
def s11_converted(spark, d):
    """From fvecs to fbin and back."""
    from vectide.sources.vecfiles import convert, read_vectors

    path, _ = written(spark, d, "fvecs")
    convert(spark, path, f"{path}.fbin")
    convert(spark, f"{path}.fbin", f"{path}.again.fvecs")
    return read_vectors(spark, f"{path}.again.fvecs").select("id", checksum("vec").alias("checksum"))


@query(K.LABELS_SQL + " SELECT namespace, value, count(*) AS n, sum(id)::BIGINT AS ids FROM lab GROUP BY namespace, value")
def s12_snapshot(spark, d):
    """A label table saved in a snapshot and opened again."""
    from vectide.sources.sinks import open_tables, save_tables

    ref = save_tables({"labels": K.label_table(embeddings(spark, d))}, {"rows": 1}, f"{work_folder(spark)}/snapshot")
    tables, _ = open_tables(spark, ref)
    return tables["labels"].groupBy("namespace", "value").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# --- preparation and quantizers ----------------------------------------------------------------------------------------------


@query(f" SELECT query_id, id, round({dot('q_vec', 'vec')}, 4) AS product FROM q, e")
def p6_rotation_keeps_products(spark, d):
    e = embeddings(spark, d)
    turned = Q.rotate(e.select("id", "vec"), Q.rotation(64))
    q = turned.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    return turned.crossJoin(q).select("query_id", "id", F.round(V.score(IP, "q", "vec"), 4).alias("product"))


def _hadamard_sql() -> str:
    draw = Q.xorshift64(42)
    out, now = "", "SELECT id, vec AS v FROM e"
    for k in range(3):
        signs = ", ".join("1.0" if next(draw) & 1 else "-1.0" for _ in range(64))
        out += f", h{k} AS (SELECT id, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN s[j + 1] ELSE -s[j + 1] END))) AS v FROM (SELECT id, list_transform(list_zip(v, [{signs}]), lambda z: z[1] * z[2]) AS s FROM ({now}) t) u)"
        now = f"SELECT id, v FROM h{k}"
    return out


@query(_hadamard_sql() + " SELECT x.id AS query_id, y.id, len(list_filter(list_zip(x.v, y.v), lambda z: (z[1] > 0) <> (z[2] > 0)))::BIGINT AS hamming FROM h2 x, h2 y WHERE x.id % 100 = 0")
def q8_hadamard_bits(spark, d):
    return K.q8_jl_hadamard(spark, d)


ORACLES["q8_jl_hadamard"] = ORACLES["q8_hadamard_bits"]


@query(" SELECT id, true AS nearest FROM e")
def q11_codes_are_nearest(spark, d):
    """Each chunk's code is that of the nearest centre of the fitted book, by a plain search."""
    e = embeddings(spark, d)
    pq = Q.ProductCode.fit(e.select("id", "vec"), centres=32)
    books = pq.books
    cuts = [0, *pq.cuts(), 64]

    def nearest(frames):
        for f in frames:
            ok = []
            for v, c in zip(f["vec"], f["code"], strict=True):
                v = np.asarray(v)
                own = [((b - v[x:y]) ** 2).sum(1) for b, x, y in zip(books, cuts, cuts[1:])]
                ok.append(all(dist[k] <= dist.min() + 1e-9 for dist, k in zip(own, c, strict=True)))
            yield f.assign(nearest=ok)[["id", "nearest"]]

    return pq.encode_table(e.select("id", "vec")).join(e.select("id", "vec"), "id").mapInPandas(nearest, "id long, nearest boolean")


@query(all_hold("no rows", "no dimension", "a book of few rows keeps them", "plus plus is no worse than half as good"))
def q12_q13_fitting(spark, d):
    x = np.stack(embeddings(spark, d).orderBy("id").limit(500).toPandas()["vec"].to_numpy())
    cost = lambda c: ((x - c[Q.nearest(x, c)]) ** 2).sum()
    return said(spark, [
        ("no rows", refused(lambda: Q.check_parameters(0, 4), "INVALID_ARGUMENT")),
        ("no dimension", refused(lambda: Q.check_parameters(4, 0), "INVALID_ARGUMENT")),
        ("a book of few rows keeps them", (Q.kmeans(x[:9], 16) == x[:9]).all()),
        ("plus plus is no worse than half as good", cost(Q.kmeans(x, 16, plus_plus=True)) < 2 * cost(Q.kmeans(x, 16))),
    ])


# --- exact search on small tables ----------------------------------------------------------------------------------------------

EIGHT = [(0.0, 1.0), (0.0, -1.0), (1.0, 0.0), (-1.0, 0.0)] * 2


@query(" SELECT metric, rank, id FROM (VALUES ('l2', [0, 1, 2]), ('ip', [2, 6, 0, 1, 4, 5, 3, 7]), ('cosine', [2, 6, 0, 1, 4, 5, 3, 7])) t(metric, ids), unnest(range(1, len(ids) + 1)) r(rank), LATERAL (SELECT ids[rank]::BIGINT AS id) s")
def x1_ties_of_eight(spark, d):
    base = spark.createDataFrame([(i, list(v)) for i, v in enumerate(EIGHT)], "id long, vec array<double>")
    ask = lambda x: spark.createDataFrame([(0, x)], "query_id long, vec array<double>")
    out = [X.topk(base, ask(q), k, m).select(F.lit(n).alias("metric"), F.col("rank").cast("long").alias("rank"), "id") for n, q, k, m in (("l2", [0.0, 0.0], 3, L2), ("ip", [1.0, 0.0], 8, IP), ("cosine", [1.0, 0.0], 8, COSINE))]
    return L.union_all(out)


@query(all_hold("k of zero", "k over the rows", "ids out of order", "an id out of range", "a zero query under cosine", "a query that is not finite", "queries of two dimensions"))
def x1_refusals(spark, d):
    base = spark.createDataFrame([(i, list(v)) for i, v in enumerate(EIGHT)], "id long, vec array<double>")
    ask = lambda *x, m=L2: X.topk(base, spark.createDataFrame(list(enumerate(x)), "query_id long, vec array<double>"), 1, m).collect()
    bad = "INVALID_ARGUMENT"
    return said(spark, [
        ("k of zero", refused(lambda: X.check_search(0), bad)), ("k over the rows", refused(lambda: X.check_search(9, 8), bad)),
        ("ids out of order", refused(lambda: X.check_subset([2, 1], 8), bad)), ("an id out of range", refused(lambda: X.check_subset([1, 8], 8), bad)),
        ("a zero query under cosine", refused(lambda: ask([0.0, 0.0], m=COSINE), bad)), ("a query that is not finite", refused(lambda: ask([1.0, float("nan")]), bad)),
        ("queries of two dimensions", refused(lambda: ask([1.0, 0.0], [1.0]), bad)),
    ])


@query(" SELECT 20 AS queries, 100 AS same", "o AS (SELECT 1)")
def x4_random_both_plans(spark, d):
    """Random rows: both plans of exact search give the same ids at the same ranks."""
    base = X.random_base(spark, 2000, 16).persist()
    q = asked(base.withColumn("label", F.lit(0)))
    a, b = X.topk(base, q, 5, L2), X.topk_expr(base, q, 5, L2)
    same = a.join(b.select("query_id", "rank", F.col("id").alias("other")), ["query_id", "rank"]).where("id = other")
    return same.agg(F.count_distinct("query_id").cast("int").alias("queries"), F.count("*").cast("int").alias("same"))


# --- labels and ids ------------------------------------------------------------------------------------------------------------


def forty_eight(spark) -> tuple[DataFrame, L.LabelStore]:
    base = spark.createDataFrame([(i, [float(i + 1), 1.0, float(i % 7 + 1)]) for i in range(48)], "id long, vec array<double>")
    store = L.LabelStore(spark, 48)
    store.update(0, [L.LabelUpdate(A, (0, 1, 2)), L.LabelUpdate(TWO, (2, 3))])
    return base, store


A, TWO, NONE = L.LabelKey("n", "a"), L.LabelKey("n", "b"), L.LabelKey("n", "unknown")


@query(" SELECT * FROM (VALUES ('all', 1, 2), ('any but none', 2, 1), ('unknown', 0, NULL), ('empty', 48, 1128)) t(filter, n, ids)", "o AS (SELECT 1)")
def l4_truth_table(spark, d):
    base, store = forty_eight(spark)
    cases = {"all": L.LabelFilter(all=(A, TWO)), "any but none": L.LabelFilter(any=(A, TWO), none=(TWO,)), "unknown": L.LabelFilter(all=(NONE,)), "empty": L.LabelFilter()}
    out = [L.resolve(store.labels, base, f).agg(F.lit(n).alias("filter"), F.count("*").cast("int").alias("n"), F.sum("id").cast("int").alias("ids")) for n, f in cases.items()]
    return L.union_all(out)


@query(all_hold("a stale revision", "a label twice", "added and removed", "an id out of range", "an empty key", "too many terms", "no change keeps the revision", "a refused batch changes nothing", "too many candidates", "an unknown external id", "no mapping", "an id twice", "too few ids", "the order asked for"))
def l2_l3_l5_l8_rules(spark, d):
    base, store = forty_eight(spark)
    ids = base.select("id", (F.col("id") + 1000).cast("decimal(20,0)").alias("external_id"))
    bad = "INVALID_ARGUMENT"
    up = lambda *c, at=1: lambda: store.update(at, list(c))
    ext = lambda *c, m=ids: lambda: store.update_external(1, list(c), m)
    rows = [
        ("a stale revision", refused(up(L.LabelUpdate(A, (5,)), at=0), "INVALID_STATE")), ("a label twice", refused(up(L.LabelUpdate(A, (5,)), L.LabelUpdate(A, (6,))), bad)),
        ("added and removed", refused(up(L.LabelUpdate(A, (5,), (5,))), bad)), ("an id out of range", refused(up(L.LabelUpdate(A, (48,))), bad)), ("an empty key", refused(up(L.LabelUpdate(L.LabelKey("", "x"), (1,))), bad)),
        ("too many terms", refused(lambda: L.LabelFilter(any=tuple(L.LabelKey("n", str(i)) for i in range(L.MAX_TERMS + 1))).check(), bad)),
        ("no change keeps the revision", store.update(1, [L.LabelUpdate(A, (0,), (9,))]) == 1),
        ("too many candidates", refused(lambda: L.within_budget(base.select("id"), 47), "RESOURCE_EXHAUSTED")),
        ("an unknown external id", refused(ext(L.ExternalLabelUpdate(A, (1003, 7))), "NOT_FOUND")), ("no mapping", refused(ext(m=None), "INVALID_STATE")),
        ("a refused batch changes nothing", store.revision == 1 and store.labels.count() == 5),
        ("an id twice", refused(lambda: L.check_ids(ids.withColumn("external_id", F.lit(1)), 48), bad)), ("too few ids", refused(lambda: L.check_ids(ids.where("id > 0"), 48), bad)),
        ("the order asked for", L.resolve_external_ids(ids, [1005, 1001, 1005]) == [5, 1, 5]),
    ]
    return said(spark, rows)


@query(all_hold("labels of other rows", "another metric", "a k that is not calibrated", "the same kind"))
def l9_l10_binding(spark, d):
    """A snapshot's labels belong to its rows; a live index is replaced by one of its kind only."""
    from vectide.index import GenerationSlot, Index

    e = base_of(spark, d)
    small = G.GraphConfig(degree=8, build_l=16, passes=1)
    make = lambda m: Index(spark, e, m, small)
    index, other = make(L2), make(IP)
    index.calibrate(asked(e), k=3, search_list_size=16)
    slot = GenerationSlot(index)
    ref = index.save(f"{work_folder(spark)}/index", include_base=False)
    turned = e.select("id", F.reverse("vec").alias("vec"))
    return said(spark, [("labels of other rows", refused(lambda: Index.open(spark, ref, turned), "CORRUPT")), ("another metric", refused(lambda: slot.replace(other), "INVALID_STATE")), ("a k that is not calibrated", refused(lambda: slot.replace(index, (4,)), "INVALID_STATE")), ("the same kind", slot.replace(index, (3,)) == 1)])


# --- graphs --------------------------------------------------------------------------------------------------------------------

SMALL = G.GraphConfig(degree=16, build_l=40, passes=1)


def base_of(spark, d) -> DataFrame:
    return embeddings(spark, d).select("id", "vec")


@query(" SELECT count(*) AS nodes, 0::BIGINT AS problems, 0::BIGINT AS unreached, true AS full FROM e")
def g1_invariants(spark, d):
    """A built graph (G1-G5, G9): every row a node, no id, degree, self-edge or duplicate out of bounds, all reached from the entry."""
    e = base_of(spark, d)
    graph = G.build(e, SMALL).persist()
    n = e.count()
    edges = {r["node"]: r["id"] for r in G.edge_list(graph).groupBy("node").agg(F.collect_list("id").alias("id")).collect()}
    entry = G.medoid_entry(e).first()["id"]
    seen, front = {entry}, [entry]
    while front:
        front = [j for i in front for j in edges.get(i, ()) if j not in seen and not seen.add(j)]
    return graph.agg(F.count("*").alias("nodes"), F.lit(G.violations(graph, n, SMALL.degree, SMALL.max_extra).count()).cast("long").alias("problems"), F.lit(n - len(seen)).cast("long").alias("unreached"), (F.min(F.size("local") + F.size("remote")) >= SMALL.degree).alias("full"))


@query(EDGES + " SELECT node, count(*) AS n FROM z WHERE zone IS NOT NULL AND node % 7 <> 0 GROUP BY node")
def g10_imported_partitions(spark, d):
    """Partitions that pass the import's checks are taken; rows with an id out of range, a self-edge or a duplicate are named."""
    g = zoned(spark, d)
    n = embeddings(spark, d).count()
    broken = g.withColumn("local", F.when(F.col("node") % 7 == 0, F.concat("local", F.when(F.col("node") % 3 == 0, F.array("node")).when(F.col("node") % 3 == 1, F.array(F.lit(n))).otherwise(F.slice("local", 1, 1)))).otherwise(F.col("local")))
    bad = G.violations(broken, n, 64, 16).select("node")
    return broken.join(bad, "node", "left_anti").select("node", (F.size("local") + F.size("remote") + F.size("extra")).cast("long").alias("n"))


@query(all_hold("degree of zero", "build_l under degree", "alpha under one", "local_pct of zero", "local_pct over 100", "defaults"))
def g11_config(spark, d):
    bad = lambda **x: refused(lambda: G.GraphConfig(**x).check(), "INVALID_ARGUMENT")
    return said(spark, [("degree of zero", bad(degree=0)), ("build_l under degree", bad(degree=9, build_l=8)), ("alpha under one", bad(alpha=0.9)), ("local_pct of zero", bad(local_pct=0)), ("local_pct over 100", bad(local_pct=101)), ("defaults", G.GraphConfig().check().degree == 64)])


@query(" SELECT count(*) AS nodes, 0::BIGINT AS problems, true AS recalled FROM e")
def g13_insert(spark, d):
    """Every fifth row inserted into the graph of the others: invariants hold, and a search finds what exact search finds."""
    e = base_of(spark, d).persist()
    old, new = e.where("id % 5 <> 0"), e.where("id % 5 = 0")
    graph = G.insert(G.build(old, SMALL), old, new, SMALL).persist()
    shared, x = B.shared_graph(e, graph, G.medoid_entry(e).first()["id"])
    c = B.Controls(10, 100, adaptive=False)
    found = B.search(asked(e), shared, B.Stages(x, L2, B.CascadeConfig("none", "exact-f32", "l2-f32")), c)
    recall = E.mean_recall(E.recall(found, X.topk(e, asked(e), 10), 10)).first()[0]
    return graph.agg(F.count("*").alias("nodes"), F.lit(G.violations(graph, e.count(), SMALL.degree, 1 << 30).count()).cast("long").alias("problems"), F.lit(recall >= 0.95).alias("recalled"))


@query(all_hold("built first", "then from the cache", "the same graph", "built for another config"))
def g15_cache(spark, d):
    from vectide.operators.cache import load_or_build

    e, folder = base_of(spark, d), work_folder(spark)
    small = G.GraphConfig(degree=8, build_l=16, passes=1)
    (a, first), (b, second), (_, third) = (load_or_build(e, c, L2, folder) for c in (small, small, replace(small, degree=9)))
    return said(spark, [("built first", first == "built"), ("then from the cache", second == "cache"), ("the same graph", a.exceptAll(b).isEmpty()), ("built for another config", third == "built")])


# --- graph search --------------------------------------------------------------------------------------------------------------

ARMS = {
    L2: [("none", a, r) for a in ("l2-u8", "l2-u16", "l2-kt", "pq-l2", "ads-f32", "exact-f32") for r in ("l2-f32", "l2-u16") if a != r] + [("jl", "l2-u8", "l2-f32"), ("jl-hadamard", "l2-u8", "l2-f32"), ("rabitq", "l2-u8", "l2-f32"), ("none", "exact-f32", "none")],
    IP: [("none", a, "ip-f32") for a in ("ip-i8", "ip-i16", "pq-ip", "exact-f32")],
    COSINE: [("none", a, "cosine-f32") for a in ("cosine-i8", "cosine-i16", "pq-cosine", "exact-f32")],
}


def recall_of(spark, found: DataFrame, truth: DataFrame) -> float:
    return E.mean_recall(E.recall(found, truth, 10)).first()[0]


for _m, _n in ((L2, "l2"), (IP, "ip"), (COSINE, "cosine")):

    def _arms(spark, d, m=_m):
        """Every arm of prefilter, admission and rerank over one graph: the recall that its precision allows."""
        e = embeddings(spark, d).select("id", "vec" if m != COSINE else V.normalized("vec").alias("vec")).persist()
        graph = G.build(e, replace(SMALL, degree=24), m).persist()
        shared, x = B.shared_graph(e, graph, G.medoid_entry(e).first()["id"])
        truth = X.topk(e, asked(e), 10, m).persist()
        out = []
        for arm in ARMS[m]:
            stages = B.Stages(x, m, B.resolve_cascade(B.CascadeConfig(*arm), m, 64))
            found = B.search(asked(e), shared, stages, B.Controls(10, 128, adaptive=False))
            out.append(("/".join(arm), recall_of(spark, found, truth) >= (0.6 if "pq" in arm[1] or "jl" in arm[0] else 0.9)))
        return said(spark, out)

    _arms.__name__ = f"a10_a12_arms_{_n}"
    query(all_hold(*("/".join(a) for a in ARMS[_m])))(_arms)


@query(all_hold("u8", "u8 ip", "u8 cosine"))
def a11_native_bytes(spark, d):
    """Byte rows, searched as they are."""
    e = embeddings(spark, d).select("id", F.col("u8").alias("vec")).persist()
    out = []
    for name, m in (("u8", L2), ("u8 ip", IP), ("u8 cosine", COSINE)):
        graph = G.build(e if m != COSINE else e.select("id", V.normalized("vec").alias("vec")), SMALL, m)
        shared, x = B.shared_graph(e, graph, G.medoid_entry(e).first()["id"])
        found = B.search(asked(e), shared, B.Stages(x, m, B.default_cascade(m, 64, True)), B.Controls(10, 128, adaptive=False))
        out.append((name, recall_of(spark, found, X.topk(e, asked(e), 10, m)) >= 0.8))
    return said(spark, out)


@query(all_hold("l2 of 512 axes", "l2", "ip", "cosine", "bytes", "ip stage under l2", "a prefilter under ip", "bytes need a native stage", "rerank no finer", "k over the rows", "a short list", "a wide window"))
def a13_a15_rules(spark, d):
    f, bad = B.resolve_cascade, "INVALID_ARGUMENT"
    c = B.CascadeConfig
    return said(spark, [
        ("l2 of 512 axes", f(c(), L2, 512) == c("jl", "l2-kt", "l2-f32")), ("l2", f(c(), L2, 64) == c("none", "l2-u8", "l2-f32")), ("ip", f(c(), IP, 64) == c("none", "ip-i8", "ip-f32")),
        ("cosine", f(c(), COSINE, 64) == c("none", "cosine-i8", "cosine-f32")), ("bytes", f(c(), L2, 64, True) == c("none", "native-l2-u8", "none")),
        ("ip stage under l2", refused(lambda: f(c(admission="ip-i8"), L2, 64), bad)), ("a prefilter under ip", refused(lambda: f(c(prefilter="rabitq"), IP, 64), bad)),
        ("bytes need a native stage", refused(lambda: f(c(admission="l2-u8"), L2, 64, True), bad)), ("rerank no finer", refused(lambda: f(c(admission="l2-u16", rerank="l2-u16"), L2, 64), bad)),
        ("k over the rows", refused(lambda: B.check_controls(9, 9, 8), bad)), ("a short list", refused(lambda: B.check_controls(8, 7, 9), bad)), ("a wide window", refused(lambda: B.check_controls(1, 1, 9, 65), bad)),
    ])


@query(all_hold("plain greedy search", "adaptive, all neighbours", "adaptive, local and extra", "adaptive, local only looks at less", "a prefix of 8 looks at less", "shards", "inverted lists", "inverted lists with codes", "layers"))
def a17_a19_e14_e17_variants(spark, d):
    """Plain and adaptive search, neighbour modes, a prefix of the neighbours, shards, and the baselines."""
    from vectide.operators.baselines import hnsw_search, ivf_pq_search

    e = base_of(spark, d).persist()
    n = e.count()
    config = replace(SMALL, degree=24)
    shared, x = B.shared_graph(e, G.build(e, config).persist(), G.medoid_entry(e).first()["id"])
    truth, stages = X.topk(e, asked(e), 10).persist(), B.Stages(x, L2, B.CascadeConfig("none", "exact-f32", "l2-f32"))
    base = B.Controls(10, 128, threshold=0.15, early_exit_limit=8)
    runs = {name: B.search(asked(e), shared, stages, c).persist() for name, c in E.ablations(base).items()}
    recall = {name: recall_of(spark, r, truth) for name, r in runs.items()}
    visits = {name: E.counters(r).first()["visits"] for name, r in runs.items()}
    sharded = B.search_shards(B.shard_graphs(G.assign_shards(e, replace(config, shard_rows=n // 3)), config, L2), asked(e), base, L2)
    return said(spark, [
        ("plain greedy search", recall["plain"] >= 0.95), ("adaptive, all neighbours", recall["full"] >= 0.9), ("adaptive, local and extra", recall["local-extra"] >= 0.85),
        ("adaptive, local only looks at less", visits["local"] <= visits["full"]), ("a prefix of 8 looks at less", visits["prefix"] <= visits["full"]), ("shards", recall_of(spark, sharded, truth) >= 0.9),
        ("inverted lists", recall_of(spark, ivf.Ivf.build(e, 16).search(asked(e), 10, 12), truth) >= 0.9), ("inverted lists with codes", recall_of(spark, ivf_pq_search(e, asked(e), 10, 16, 16), truth) >= 0.8),
        ("layers", recall_of(spark, hnsw_search(e, asked(e), 10, width=128), truth) >= 0.9),
    ])


@query(" SELECT count(*) AS queries, 10 * count(*) AS results FROM q")
def a16_batches(spark, d):
    """A batch keeps its queries apart: every query has its ten ranks once, its own row at the first."""
    e = base_of(spark, d)
    shared, x = B.shared_graph(e, G.build(e, SMALL), G.medoid_entry(e).first()["id"])
    found = B.search(asked(e), shared, B.Stages(x, L2, B.CascadeConfig("none", "exact-f32", "l2-f32")), B.Controls(10, 64, adaptive=False))
    return found.dropDuplicates(["query_id", "rank"]).agg(F.count_distinct(F.when((F.col("rank") == 1) & (F.col("id") == F.col("query_id")), F.col("query_id"))).alias("queries"), F.count("*").alias("results"))


# --- calibration and traces ------------------------------------------------------------------------------------------------------


@query(" SELECT * FROM (VALUES (9::BIGINT, 'useful'), (11::BIGINT, 'tail')) t(gap, kind)", "o AS (SELECT 1)")
def c1_chain(spark, d):
    """A path of 20 rows whose first and eleventh are the nearest: the walk brings them in nine steps apart."""
    x = np.array([[1.0 if i == 0 else 1.1 if i == 10 else i + 10.0] for i in range(20)], np.float32)
    full = [np.array([i + 1] if i < 19 else [], np.int32) for i in range(20)]
    graph = B.SharedGraph(np.arange(20), full, full, [np.zeros(0, np.int32)] * 20, 0)
    stages = B.Stages(x, L2, B.CascadeConfig("none", "exact-f32", "l2-f32"))
    q = spark.createDataFrame([(0, [1.0])], "query_id long, vec array<double>")
    return C.useful_gaps(C.trace_table(q, graph, stages, 2, 20)).select(F.col("gap").cast("long").alias("gap"), "kind")


@query(all_hold("beam of k 10", "beam of k 100", "ks twice", "published together", "no calibration", "first queries"))
def c7_c9_records(spark, d):
    from vectide.index import Index

    e = base_of(spark, d)
    index = Index(spark, e, L2, G.GraphConfig(degree=8, build_l=16, passes=1))
    many = index.calibrate_many(asked(e, "vec"), ks=[3, 5], search_list_size=24)
    return said(spark, [
        ("beam of k 10", C.default_beam(10) == 48), ("beam of k 100", C.default_beam(100) == 200), ("ks twice", refused(lambda: index.calibrate_many(asked(e), ks=[3, 3]), "INVALID_ARGUMENT")),
        ("published together", index.calibrated_ks == [3, 5] and [c.k for c in many] == [3, 5]), ("no calibration", refused(lambda: index.search(asked(e), k=4, search_list_size=16), "INVALID_STATE")),
        ("first queries", [r["query_id"] for r in C.first_queries(e.select(F.col("id").alias("query_id")), 3).orderBy("query_id").collect()] == [0, 1, 2]),
    ])


TRACE = ", t AS (SELECT user_id AS query_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seq, CASE length(event_type) % 3 WHEN 0 THEN 'expansion' WHEN 1 THEN 'admission' ELSE 'beam' END AS type, event_id % 50 AS node, [event_id % 50, event_id % 7] AS ids FROM events)"


def traced(spark, d) -> DataFrame:
    """The event table as a trace: a user's events in order."""
    t = spark.read.parquet(f"{d}/events.parquet")
    kind = F.length("event_type") % 3
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t.select(F.col("user_id").alias("query_id"), seq.cast("int").alias("seq"), F.when(kind == 0, "expansion").when(kind == 1, "admission").otherwise("beam").alias("type"), (F.col("event_id") % 50).alias("node"), F.array(F.col("event_id") % 50, F.col("event_id") % 7).alias("ids"))


@query(", c AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, length(event_type) AS pre, (value * 0)::BIGINT + event_id % 5 AS post FROM events) SELECT count(*) AS queries, sum(pre)::BIGINT AS pre_hops, sum(post)::BIGINT AS post_hops, sum(pre + post)::BIGINT AS expansions FROM c WHERE rank = 1")
def e8_counters(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    rank, pre, post, zero = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")), F.length("event_type").cast("long"), F.col("event_id") % 5, F.lit(0).cast("long")
    rows = t.select(rank.alias("rank"), pre.alias("pre_hops"), post.alias("post_hops"), (pre + post).alias("expansions"), *[zero.alias(c) for c in ("pre_admits", "post_admits", "visits", "raw_visits", "sketch_evaluations")])
    return E.counters(rows).select("queries", "pre_hops", "post_hops", "expansions")


@query(" SELECT count(*) AS queries, 0::BIGINT AS problems FROM q")
def e9_traces_are_whole(spark, d):
    """Traces of real searches: each begins with its entry and has no gap."""
    from vectide.operators.beam import trace_of

    e = base_of(spark, d)
    shared, x = B.shared_graph(e, G.build(e, SMALL), G.medoid_entry(e).first()["id"])
    t = trace_of(asked(e), shared, B.Stages(x, L2, B.CascadeConfig("none", "l2-u8", "l2-f32")), B.Controls(10, 48)).persist()
    return t.agg(F.count_distinct("query_id").alias("queries"), F.lit(E.trace_problems(t).count()).cast("long").alias("problems"))


@query(TRACE + " SELECT query_id, seq, type FROM t WHERE query_id = 3 AND seq BETWEEN 2 AND 6")
def e10_trace_page(spark, d):
    return E.trace_page(traced(spark, d), 3, 2, 5).select("query_id", "seq", "type")


@query(TRACE + ", o AS (SELECT query_id, count(*) AS n, max(seq) AS last, count(DISTINCT seq) AS dist, arg_min(type, seq) AS first FROM (SELECT query_id, seq + CASE WHEN query_id % 4 = 0 AND seq > 1 THEN 1 ELSE 0 END AS seq, CASE WHEN seq = 0 AND query_id % 3 = 0 THEN 'entry' ELSE type END AS type FROM t) u GROUP BY query_id) SELECT query_id, CASE WHEN last + 1 <> n OR dist <> n THEN 'gaps' ELSE 'no entry' END AS problem FROM o WHERE last + 1 <> n OR dist <> n OR first <> 'entry'")
def e10_trace_problems(spark, d):
    t = traced(spark, d)
    seq = F.col("seq") + F.when((F.col("query_id") % 4 == 0) & (F.col("seq") > 1), 1).otherwise(0)
    kind = F.when((F.col("seq") == 0) & (F.col("query_id") % 3 == 0), "entry").otherwise(F.col("type"))
    return E.trace_problems(t.select("query_id", seq.alias("seq"), kind.alias("type")))


@query(TRACE + ", f AS (SELECT *, last_value(CASE WHEN type = 'expansion' THEN node END IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY seq) AS frm FROM t), c AS (SELECT frm, unnest(ids) AS id FROM f WHERE type = 'admission') SELECT (id * 3 + frm) % 11 AS position, count(*) AS admitted FROM c WHERE frm IS NOT NULL AND id < 30 GROUP BY ALL")
def e13_position_contribution(spark, d):
    edges = spark.range(50).select(F.col("id").alias("node")).crossJoin(spark.range(30)).select("node", "id", ((F.col("id") * 3 + F.col("node")) % 11).alias("position"))
    return E.position_contribution(traced(spark, d), edges)


@query(TRACE + ", s AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS step FROM t WHERE type = 'expansion'), m AS (SELECT query_id, min(step) FILTER (node % 9 = 0) AS parted, max(step) AS last FROM s GROUP BY query_id) SELECT query_id, coalesce(parted, last + 1) - 1 AS shared_steps FROM m")
def e15_matched_states(spark, d):
    """Two traces that part where a node divisible by nine comes."""
    a = traced(spark, d)
    b = a.withColumn("node", F.when(F.col("node") % 9 == 0, -1).otherwise(F.col("node")))
    return E.matched_states(a, b).select("query_id", F.col("shared_steps").cast("long").alias("shared_steps"))


@query(TRACE + ", p AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'exploring' ELSE 'converged' END AS phase, type, ids FROM t) SELECT phase, count(*) FILTER (type = 'expansion') AS expansions, sum(CASE WHEN type = 'expansion' THEN len(ids) ELSE 0 END)::BIGINT AS looked_at, sum(CASE WHEN type = 'admission' THEN len(ids) ELSE 0 END)::BIGINT AS admitted FROM p GROUP BY phase")
def e15_phase_work(spark, d):
    return E.phase_work(traced(spark, d).withColumn("phase", F.when(F.col("query_id") % 2 == 0, "exploring").otherwise("converged")))


# --- arrays, streams, interpolation ------------------------------------------------------------------------------------------------


@query(f" SELECT id, {CHECKSUM.format(v='list_transform(unit, lambda x: x::FLOAT::DOUBLE)')} AS floats, {CHECKSUM.format(v='u8')} AS bytes FROM e")
def s3_arrays(spark, d):
    """Arrays in memory become tables, with the row's position as its id."""
    from vectide.sources.vecfiles import from_array

    rows = embeddings(spark, d).orderBy("id").select("unit", "u8").toPandas()
    floats, whole = (np.stack(rows[c].to_numpy()).astype(t) for c, t in (("unit", np.float32), ("u8", np.uint8)))
    return from_array(spark, floats).select("id", checksum("vec").alias("floats")).join(from_array(spark, whole).select("id", checksum("vec").alias("bytes")), "id")


@query(K.topk_sql(L2, 3).replace("rank, id, round(score, 4) AS score", "rank, id"))
def s6_query_stream(spark, d):
    """Queries that arrive as files, answered batch by batch."""
    from vectide.streaming.queries import exact_stream, query_source

    e, folder = embeddings(spark, d), work_folder(spark)
    asked(e).repartition(3).write.parquet(f"{folder}/queries")
    exact_stream(e.select("id", "vec"), query_source(spark, f"{folder}/queries"), 3, f"{folder}/found", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/found").select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@query(K.topk_sql(L2, 3).replace("query_id, rank, id, round(score, 4) AS score", "query_id // 100 AS query_id, rank, id"))
def s6_piped_queries(spark, d):
    """Queries that come through a pipe, two at a time; they are numbered as they come."""
    import io

    from vectide.streaming.queries import piped_queries

    e = embeddings(spark, d)
    rows = [np.asarray(r["vec"], np.float32) for r in asked(e).orderBy("query_id").collect()]
    pipe = io.BytesIO(b"".join(np.array([len(v)], "<u4").tobytes() + v.tobytes() for v in rows))
    parts = [X.topk(e.select("id", "vec"), q, 3, L2) for q in piped_queries(spark, pipe, batch=2)]
    return L.union_all(parts).select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@query(", " + K.RUNS + ", b AS (SELECT recall, max(qps) AS qps FROM r GROUP BY recall), f AS (SELECT recall, qps, max(qps) OVER (ORDER BY recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b), g AS (SELECT recall, qps, lead(recall) OVER (ORDER BY recall) AS r1, lead(qps) OVER (ORDER BY recall) AS q1 FROM f WHERE above IS NULL OR qps > above) SELECT round(max(CASE WHEN recall = 0.9012 THEN qps WHEN recall < 0.9012 AND 0.9012 < r1 THEN qps + (q1 - qps) * (0.9012 - recall) / (r1 - recall) END), 4) AS qps FROM g")
def e6_qps_at_a_recall(spark, d):
    return E.qps_at(K.runs(spark, d), 0.9012).select(F.round("qps", 4).alias("qps"))
