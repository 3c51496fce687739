"""The engine's queries over the test tables, each with SQL for the same rows where SQL can express it.

Searches take as queries every vector whose id is divisible by 100, against all vectors. Unit vectors rank alike under
all metrics, so most queries use a scaled copy (times 1 + label) or a byte copy (round((x + 1) * 127)).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectide.functions import vectors as V
from vectide.functions.vectors import COSINE, IP, L2
from vectide.operators import evaluation as E, exact as X, graph as G, labels as L, quantizers as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: CTEs that the oracles build on.
SQL = """
e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS unit,
  list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS vec,
  list_transform(embedding, lambda x: round((x::DOUBLE + 1) * 127)::BIGINT) AS u8 FROM embeddings),
q AS (SELECT id AS query_id, unit AS q_unit, vec AS q_vec, u8 AS q_u8 FROM e WHERE id % 100 = 0)"""


def query(sql: str | None = None):
    """Registers a query under its function's name; the SQL continues the CTEs above."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + SQL + sql
        return f

    return add


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def cos(a: str, b: str) -> str:
    return f"greatest(-1.0, least(1.0, {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))))"


SCORES = {L2: l2("q_vec", "vec"), IP: dot("q_vec", "vec"), COSINE: cos("q_vec", "vec")}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, unit, vec, u8)."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = F.col("embedding").cast("array<double>")
    return t.select(F.col("vec_id").alias("id"), "label", unit.alias("unit"), F.transform(unit, lambda x: x * (1 + F.col("label"))).alias("vec"), F.transform(unit, lambda x: F.round((x + 1) * 127).cast("bigint")).alias("u8"))


def asked(e: DataFrame, column: str = "vec") -> DataFrame:
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col(column).alias("vec"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query against every row; the queries are broadcast in plan form, as they are a hundredth of the rows."""
    e = embeddings(spark, sf_dir)
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("unit").alias("q_unit"), F.col("vec").alias("q_vec"), F.col("u8").alias("q_u8"))
    return e.crossJoin(q)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x1_topk_l2(spark, sf_dir)


# --- preparation and distances -------------------------------------------------------------------------------------


@query("SELECT id, list_sum(list_transform(list_transform(vec, lambda x: (x / n)::FLOAT), lambda x: round(x::DOUBLE, 4))) AS checksum FROM (SELECT id, vec, sqrt(" + dot("vec", "vec") + ") AS n FROM e) t")
def p1_normalize(spark, d):
    n = embeddings(spark, d).select("id", V.normalized("vec").alias("n"))
    return n.select("id", V.total(F.transform("n", lambda x: F.round(x.cast("double"), 4))).alias("checksum"))


@query("SELECT id, len(list_filter(vec, lambda x: NOT isfinite(x))) = 0 AS finite FROM e")
def p2_finite(spark, d):
    return embeddings(spark, d).select("id", V.all_finite("vec").alias("finite"))


@query("SELECT id, len(list_filter(u8, lambda x: x < 0 OR x > 255)) = 0 AS bytes, len(list_filter(vec, lambda x: x < 0 OR x > 255 OR x <> floor(x))) = 0 AS floats FROM e")
def p3_narrow_u8(spark, d):
    return embeddings(spark, d).select("id", V.fits_u8("u8").alias("bytes"), V.fits_u8("vec").alias("floats"))


@query("SELECT id, " + dot("u8", "u8") + "::BIGINT AS norm2 FROM e")
def p4_squared_norm(spark, d):
    return embeddings(spark, d).select("id", V.squared_norm_exact("u8").alias("norm2"))


@query(" SELECT id, 0.0::DOUBLE AS drift FROM e")
def p6_rotation(spark, d):
    """What a rotation does to the norms."""
    e = embeddings(spark, d)
    turned = Q.rotate(e.select("id", "vec"), Q.rotation(64))
    return turned.join(e.select("id", F.col("vec").alias("v")), "id").select("id", F.round(F.abs(V.norm("vec") - V.norm("v")), 6).alias("drift"))


for _m, _n in ((L2, "d1_squared_l2"), (IP, "d2_inner_product"), (COSINE, "d3_cosine")):

    def _score(spark, d, m=_m):
        return pairs(spark, d).select("query_id", "id", F.round(V.score(m, "q_vec", "vec"), 5).alias("score"))

    _score.__name__ = _n
    query(f" SELECT query_id, id, round({SCORES[_m]}, 5) AS score FROM q, e")(_score)


@query(f" SELECT query_id, id, round({SCORES[L2]}, 5) AS l2, round(-{SCORES[IP]}, 5) AS ip, round(1.0 - {SCORES[COSINE]}, 5) AS cos FROM q, e")
def d4_calibration_distance(spark, d):
    c = lambda m: F.round(V.calibration_distance(m, "q_vec", "vec"), 5)
    return pairs(spark, d).select("query_id", "id", c(L2).alias("l2"), c(IP).alias("ip"), c(COSINE).alias("cos"))


@query(f" SELECT query_id, id, round(greatest(0.0, least(1.0, 1.0 - {cos('q_u8', 'u8')})), 6) AS dist FROM q, e")
def d5_u8_cosine_distance(spark, d):
    return pairs(spark, d).select("query_id", "id", F.round(V.u8_cosine_distance("q_u8", "u8"), 6).alias("dist"))


@query(f" SELECT query_id, id, {l2('q_u8', 'u8')}::BIGINT AS l2, {dot('q_u8', 'u8')}::BIGINT AS ip, list_sum(list_transform(list_zip(q_u8, u8), lambda z: bit_count(xor(z[1], z[2]))))::BIGINT AS hamming FROM q, e")
def d6_integer_kernels(spark, d):
    a, b = F.col("q_u8"), F.col("u8")
    return pairs(spark, d).select("query_id", "id", V.int_l2(a, b).alias("l2"), V.int_dot(a, b).alias("ip"), V.hamming(a, b).alias("hamming"))


@query(" SELECT query_id, id, round(CASE WHEN dist < 2.0 THEN dist ELSE -1 END, 5) AS dist FROM (SELECT query_id, id, " + l2("q_unit", "unit") + " AS dist FROM q, e) t")
def d8_early_abandon(spark, d):
    return pairs(spark, d).select("query_id", "id", F.round(V.early_abandon_l2("q_unit", "unit", F.lit(2.0)), 5).alias("dist"))


@query(" SELECT query_id, id, round(CASE WHEN p16 * 64 / 16 > 2.0 * (1 + 2.1 / sqrt(16)) OR p32 * 64 / 32 > 2.0 * (1 + 2.1 / sqrt(32)) OR p48 * 64 / 48 > 2.0 * (1 + 2.1 / sqrt(48)) OR dist >= 2.0 THEN -1 ELSE dist END, 5) AS dist FROM (SELECT query_id, id, " + l2("q_unit", "unit") + " AS dist, " + ", ".join(f"{l2(f'q_unit[1:{k}]', f'unit[1:{k}]')} AS p{k}" for k in (16, 32, 48)) + " FROM q, e) t")
def d9_adsampling(spark, d):
    return pairs(spark, d).select("query_id", "id", F.round(V.adsampling_l2("q_unit", "unit", F.lit(2.0), 64, step=16), 5).alias("dist"))


# --- exact search ----------------------------------------------------------------------------------------------------


def topk_sql(metric: str, k: int, where: str = "true", dist: str | None = None) -> str:
    key = f"({dist or SCORES[metric]})::FLOAT" + (" ASC" if metric == L2 else " DESC")
    return f" SELECT query_id, rank, id, round(score, 4) AS score FROM (SELECT query_id, id, {dist or SCORES[metric]} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {key}, id) AS rank FROM q, e WHERE {where}) t WHERE rank <= {k}"


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 4).alias("score"))


for _m, _n in ((L2, "l2"), (IP, "ip"), (COSINE, "cosine")):

    def _blocked(spark, d, m=_m):
        e = embeddings(spark, d)
        return shown(X.topk(e.select("id", "vec"), asked(e), 10, m))

    def _expr(spark, d, m=_m):
        e = embeddings(spark, d)
        return shown(X.topk_expr(e.select("id", "vec"), asked(e), 10, m))

    _blocked.__name__, _expr.__name__ = f"x1_topk_{_n}", f"x3_ground_truth_{_n}"
    query(topk_sql(_m, 10))(_blocked)
    query(topk_sql(_m, 10))(_expr)
x1_topk_l2 = QUERIES["x1_topk_l2"]


@query(topk_sql(L2, 10, dist=l2("q_u8", "u8")).replace("round(score, 4)", "round(score::DOUBLE, 4)"))
def x1_topk_u8(spark, d):
    e = embeddings(spark, d)
    return shown(X.topk(e.select("id", F.col("u8").alias("vec")), asked(e, "u8"), 10, L2))


def label_table(e: DataFrame) -> DataFrame:
    digit, half = e.select(F.lit("label").alias("namespace"), F.col("label").cast("string").alias("value"), "id"), e.select(F.lit("half").alias("namespace"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("value"), "id")
    return digit.union(half)


FILTER = L.LabelFilter(all=(L.LabelKey("half", "even"),), any=(L.LabelKey("label", "1"), L.LabelKey("label", "3"), L.LabelKey("label", "4")), none=(L.LabelKey("label", "3"),))
FILTER_SQL = "id % 2 = 0 AND label IN (1, 3, 4) AND label <> 3"


@query(topk_sql(IP, 10, FILTER_SQL))
def x2_filtered_search(spark, d):
    e = embeddings(spark, d)
    ids = L.resolve(label_table(e), e, FILTER)
    return shown(X.topk_of_subset(e.select("id", "vec"), ids, asked(e), 10, IP))


@query()
def x4_random_ground_truth(spark, d):
    base = X.random_base(spark, 2000, 16)
    return shown(X.topk(base, asked(base.withColumn("label", F.lit(0))), 5, L2))


@query(f" SELECT query_id, rank, t.id, round({SCORES[COSINE]}, 5) AS score FROM ({topk_sql(L2, 5).replace('round(score, 4) AS score', 'rank AS r')}) t JOIN q USING (query_id) JOIN e ON t.id = e.id")
def x5_rescored(spark, d):
    e = embeddings(spark, d)
    found = X.topk(e.select("id", "vec"), asked(e), 5, L2)
    return X.with_scores(found, e.select("id", "vec"), asked(e), COSINE).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 5).alias("score"))


SELF_KNN = f"knn AS (SELECT node, id, dist, rank FROM (SELECT a.id AS node, b.id AS id, {l2('a.vec', 'b.vec')} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY ({l2('a.vec', 'b.vec')})::FLOAT, b.id) AS rank FROM e a, e b WHERE a.id <> b.id) t WHERE rank <= 10)"


def knn(e: DataFrame, k: int = 10) -> DataFrame:
    return X.self_knn(e.select("id", "vec"), k).select(F.col("query_id").alias("node"), "id", F.col("score").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(", " + SELF_KNN + " SELECT node, rank, id FROM knn")
def x6_self_knn(spark, d):
    return knn(embeddings(spark, d)).select("node", "rank", "id")


# --- quantizers --------------------------------------------------------------------------------------------------------

AFFINE = ", r AS (SELECT min(list_min(vec))::FLOAT AS low, max(list_max(vec))::FLOAT AS high FROM e), s AS (SELECT (CAST({top} AS FLOAT) / greatest((high - low)::FLOAT, 1e-9::FLOAT))::FLOAT AS slope, low FROM r), o AS (SELECT slope, round((low * slope)::FLOAT) AS off FROM s), c AS (SELECT id, list_transform(vec, lambda x: greatest(0, least({top}, round(((x::FLOAT) * slope)::DOUBLE) - off))::BIGINT) AS code FROM e, o)"
SYMMETRIC = ", r AS (SELECT greatest(abs(min(list_min(vec))), abs(max(list_max(vec))))::FLOAT AS m FROM e), s AS (SELECT CASE WHEN m = 0 THEN 1::FLOAT ELSE ({top}::FLOAT / m)::FLOAT END AS scale FROM r), c AS (SELECT id, list_transform(vec, lambda x: greatest(-{top}, least({top}, round(((x::FLOAT) * scale)::DOUBLE)))::BIGINT) AS code FROM e, s)"
ESTIMATES = " SELECT a.id AS query_id, b.id AS id, {f} AS estimate, list_sum(b.code)::BIGINT AS checksum FROM c a, c b WHERE a.id % 100 = 0"


def estimates(e: DataFrame, fitted) -> DataFrame:
    c = e.select("id", fitted.encode(F.col("vec")).alias("code"))
    q = c.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    return c.crossJoin(q).select("query_id", "id", fitted.estimate(F.col("q"), F.col("code")).cast("long").alias("estimate"), F.aggregate("code", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("checksum"))


for _n, _fit, _sql, _f in (
    ("q1_l2_u8", Q.fit_l2_u8, AFFINE.format(top=255), l2("a.code", "b.code")),
    ("q2_l2_u16", Q.fit_l2_u16, AFFINE.format(top=65535), l2("a.code", "b.code")),
    ("q3_mips_i8", Q.fit_mips_i8, SYMMETRIC.format(top=127), "-" + dot("a.code", "b.code")),
    ("q4_mips_i16", Q.fit_mips_i16, SYMMETRIC.format(top=32767), "-" + dot("a.code", "b.code")),
    ("q5_l2_kt", Q.fit_l2_kt, AFFINE.format(top=255).replace("::BIGINT) AS code", "::BIGINT - 128) AS code"), f"{dot('a.code', 'a.code')} + {dot('b.code', 'b.code')} - 2 * {dot('a.code', 'b.code')}"),
):

    def _quantized(spark, d, fit=_fit):
        e = embeddings(spark, d)
        return estimates(e, fit(e))

    _quantized.__name__ = _n
    query(_sql + ESTIMATES.format(f=f"({_f})::BIGINT"))(_quantized)

_SKETCH = Q.sparse_indices(64, bits=128)
_BITS = "[" + ", ".join("[" + ", ".join(str(i + 1) for i in row) + "]" for row in _SKETCH) + "]"
JL_SQL = f", b AS (SELECT id, vec, list_transform({_BITS}, lambda r: (vec[r[1]] + vec[r[2]] + vec[r[3]] + vec[r[4]] - (vec[r[5]] + vec[r[6]] + vec[r[7]] + vec[r[8]] + vec[r[9]])) > 0) AS bits FROM e)"


@query(JL_SQL + " SELECT x.id AS query_id, y.id AS id, len(list_filter(list_zip(x.bits, y.bits), lambda z: z[1] <> z[2]))::BIGINT AS hamming, round(len(list_filter(list_zip(x.bits, y.bits), lambda z: z[1] <> z[2])) * sqrt(" + dot("y.vec", "y.vec") + "), 4) AS mips FROM b x, b y WHERE x.id % 100 = 0")
def q6_q7_jl_sparse(spark, d):
    e = embeddings(spark, d)
    sketch = Q.SparseSketch(_SKETCH)
    c = sketch.encode_table(e.select("id", "vec")).join(e.select("id", V.norm("vec").alias("norm")), "id")
    q = c.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    near = sketch.estimate(F.col("q"), F.col("code"))
    return c.crossJoin(q).select("query_id", "id", near.alias("hamming"), F.round(sketch.estimate(F.col("q"), F.col("code"), F.col("norm")), 4).alias("mips"))


@query()
def q8_jl_hadamard(spark, d):
    e = embeddings(spark, d)
    c = Q.encode_signs(e.select("id", "vec"), Q.hadamard_bits(64))
    q = c.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    return c.crossJoin(q).select("query_id", "id", V.hamming(F.col("q"), F.col("code")).alias("hamming"))


def _one_bit(e: DataFrame) -> DataFrame:
    code = Q.OneBitCode(64)
    c = e.select("id", "vec", code.encode(F.col("vec")).alias("c"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    return c.crossJoin(q).select("query_id", "id", F.round(code.estimate(F.col("q"), F.col("c")), 4).alias("estimate"), F.round(F.col("c.s"), 4).alias("s"))


@query(f" SELECT query_id, id, round(greatest(0.0, {dot('q_vec', 'q_vec')} + {dot('vec', 'vec')} - 2 * list_sum(list_transform(list_zip(q_vec, vec), lambda z: CASE WHEN z[2] >= 0 THEN z[1] ELSE -z[1] END)) * sqrt({dot('vec', 'vec')}) / sqrt(2 * 64 / pi())), 4) AS estimate, round(list_sum(list_transform(vec, lambda x: abs(x))) / sqrt({dot('vec', 'vec')}), 4) AS s FROM q, e")
def q9_rabitq_given_rotation(spark, d):
    return _one_bit(embeddings(spark, d))


@query(f", t AS (SELECT id, vec, list_max(list_transform(vec, lambda x: abs(x))) AS tau FROM e), c AS (SELECT id, vec, tau, list_transform(vec, lambda x: greatest(-7, least(7, round(x * 7 / tau)))) AS code FROM t) SELECT query_id, id, round(greatest(0.0, {dot('q_vec', 'q_vec')} + {dot('vec', 'vec')} - 2 * {dot('q_vec', 'code')} * tau / 7), 4) AS estimate FROM q, c")
def q10_rabitq4_given_rotation(spark, d):
    e, code = embeddings(spark, d), Q.FourBitCode()
    c = e.select("id", code.encode(F.col("vec")).alias("c"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    return c.crossJoin(q).select("query_id", "id", F.round(code.estimate(F.col("q"), F.col("c")), 4).alias("estimate"))


@query()
def q11_product_codes(spark, d):
    e = embeddings(spark, d)
    pq = Q.ProductCode.fit(e.select("id", "vec"), centres=64)
    return pq.encode_table(e.select("id", "vec")).select("id", F.col("code").cast("array<int>").alias("code"))


#: A code book given as data: two chunks of 32 axes, the first 16 vectors are the centres.
BOOK_SQL = f", n AS (SELECT id, 0 AS chunk, vec[1:32] AS v FROM e UNION ALL SELECT id, 1, vec[33:64] FROM e), w AS (SELECT n.id, n.chunk, arg_min(b.id, struct_pack(a := ({l2('n.v', 'b.v')})::FLOAT, b := b.id)) AS centre FROM n JOIN n b ON n.chunk = b.chunk AND b.id < 16 GROUP BY n.id, n.chunk), lookup AS (SELECT n.id AS query_id, n.chunk, b.id AS centre, {l2('n.v', 'b.v')} AS d FROM n JOIN n b ON n.chunk = b.chunk AND b.id < 16 WHERE n.id % 100 = 0)"


@query(BOOK_SQL + " SELECT query_id, w.id, round(sum(d), 4) AS estimate FROM w JOIN lookup USING (chunk, centre) GROUP BY query_id, w.id")
def q11_pq_given_codebook(spark, d):
    e = embeddings(spark, d)
    cut = e.select("id", F.posexplode(F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))).alias("chunk", "v"))
    book = F.broadcast(cut.where("id < 16").select(F.col("id").alias("centre"), "chunk", F.col("v").alias("b")))  # 32 rows
    near = cut.join(book, "chunk").withColumn("d", V.squared_l2("v", "b"))
    best = near.groupBy("id", "chunk").agg(F.min_by("centre", F.struct(F.col("d").cast("float"), "centre")).alias("centre"))
    codes = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "centre"))), lambda s: s["centre"]).alias("code"))
    lookup = near.where("id % 100 = 0").select(F.col("id").alias("query_id"), "chunk", "centre", "d")
    return Q.adc_estimate(codes, lookup).select("query_id", "id", F.round("estimate", 4).alias("estimate"))


@query(AFFINE.format(top=255) + f", est AS (SELECT a.id AS query_id, b.id AS id, row_number() OVER (PARTITION BY a.id ORDER BY {l2('a.code', 'b.code')}, b.id) AS rank FROM c a, c b WHERE a.id % 100 = 0), f AS (SELECT query_id, est.id, {SCORES[L2]} AS score FROM est JOIN q USING (query_id) JOIN e ON est.id = e.id WHERE rank <= 20) SELECT query_id, id, rank, score FROM (SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score::FLOAT, id) AS rank FROM f) t WHERE rank <= 10")
def a9_flat_cascade(spark, d):
    e = embeddings(spark, d)
    codes = e.select("id", Q.fit_l2_u8(e).encode(F.col("vec")).alias("vec"))
    first = X.topk(codes, codes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec"), 20, L2, whole_keys=True)
    return shown(X.rerank(first, e.select("id", "vec"), asked(e), 10, L2)).select("query_id", "id", "rank", "score")


# --- graphs -------------------------------------------------------------------------------------------------------------


@query(", " + SELF_KNN + ", g AS (SELECT node, id, dist, rank % 3 <> 0 AS original FROM knn), p AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dist, id) AS r, sum(original::INT) OVER (PARTITION BY node) AS deg FROM g), z AS (SELECT node, id, CASE WHEN r <= floor(0.6 * deg + 0.5) AND original THEN 'local' WHEN original THEN 'remote' WHEN r <= floor(0.6 * deg + 0.5) THEN 'extra' END AS zone FROM p) SELECT node, zone, id FROM z WHERE zone IS NOT NULL")
def g6_zones(spark, d):
    g = G.zones(knn(embeddings(spark, d)).withColumn("original", F.col("rank") % 3 != 0))
    return g.select("node", F.explode(F.create_map(F.lit("local"), F.col("local"), F.lit("remote"), F.col("remote"), F.lit("extra"), F.col("extra"))).alias("zone", "ids")).select("node", "zone", F.explode("ids").alias("id"))


@query(f", m AS (SELECT list(v ORDER BY axis) AS mean FROM (SELECT axis, avg(vec[axis]) AS v FROM e, range(1, 65) t(axis) GROUP BY axis) u) SELECT arg_min(id, struct_pack(a := {l2('vec', 'mean')}, b := id)) AS id FROM e, m")
def g7_centroid_entry(spark, d):
    return G.centroid_entry(embeddings(spark, d))


@query(f", n AS (SELECT count(*) AS n, sum({dot('vec', 'vec')}) AS squares FROM e), m AS (SELECT list(v ORDER BY axis) AS sums FROM (SELECT axis, sum(vec[axis]) AS v FROM e, range(1, 65) t(axis) GROUP BY axis) u), t AS (SELECT id, round(n * {dot('vec', 'vec')} - 2 * {dot('vec', 'sums')} + squares, 6) AS total FROM e, n, m) SELECT arg_min(id, struct_pack(a := total, b := id)) AS id FROM t")
def g8_medoid_entry(spark, d):
    return G.medoid_entry(embeddings(spark, d))


@query(", " + SELF_KNN + " SELECT count(DISTINCT node) AS nodes, count(*) AS edges, (SELECT count(*) FROM knn a JOIN knn b ON a.node = b.id AND a.id = b.node) AS bidirectional, count(*) / count(DISTINCT node) AS avg_degree FROM knn")
def g12_graph_stats(spark, d):
    edges = knn(embeddings(spark, d))
    graph = edges.groupBy("node").agg(F.collect_list("id").alias("local")).withColumn("remote", F.array().cast("array<long>"))
    both = F.broadcast(G.bidirectional(edges).agg(F.count("*").alias("bidirectional")))  # one row
    return G.stats(graph).crossJoin(both).select("nodes", "edges", "bidirectional", "avg_degree")


@query(f" SELECT query_id, rank, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ({SCORES[L2]})::FLOAT, id) AS rank FROM q, e WHERE label <> 2) t WHERE rank <= 10")
def g14_soft_delete(spark, d):
    e = embeddings(spark, d)
    gone = e.where("label = 2").select("id")
    found = X.topk(e.select("id", "vec"), asked(e), 10 + gone.count(), L2)
    return G.suppress(found, gone, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "id")


# --- labels and ids --------------------------------------------------------------------------------------------------

LABELS_SQL = ", lab AS (SELECT 'label' AS namespace, label::VARCHAR AS value, id FROM e UNION ALL SELECT 'half', CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END, id FROM e)"


@query(LABELS_SQL + " SELECT namespace, value, id FROM lab WHERE NOT (namespace = 'label' AND value = '1' AND id % 3 = 0) UNION SELECT 'label', '2', id FROM e WHERE id % 5 = 0")
def l1_update_labels(spark, d):
    e = embeddings(spark, d)
    gone = e.where("label = 1 and id % 3 = 0").select(F.lit("label").alias("namespace"), F.lit("1").alias("value"), "id", F.lit("remove").alias("op"))
    more = e.where("id % 5 = 0").select(F.lit("label").alias("namespace"), F.lit("2").alias("value"), "id", F.lit("add").alias("op"))
    return L.apply_changes(label_table(e), gone.union(more))


@query(" SELECT id AS ord, 1000 + id * 2 AS external_id, CASE WHEN id * 2 < (SELECT count(*) FROM e) THEN id * 2 END AS id FROM e")
def l3_l6_resolve_external(spark, d):
    e = embeddings(spark, d)
    ids = e.select("id", (F.col("id") + 1000).alias("external_id"))
    return L.resolve_external(ids, e.select(F.col("id").alias("ord"), (1000 + F.col("id") * 2).alias("external_id")))


@query(f" SELECT id FROM e WHERE {FILTER_SQL}")
def l4_label_filter(spark, d):
    e = embeddings(spark, d)
    return L.resolve(label_table(e), e, FILTER)


@query(topk_sql(L2, 3).replace("id, round(score, 4) AS score", "id, 1000 + id AS external_id"))
def l7_external_results(spark, d):
    e = embeddings(spark, d)
    found = X.topk(e.select("id", "vec"), asked(e), 3, L2)
    return L.attach_external_ids(found, e.select("id", (F.col("id") + 1000).alias("external_id"))).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "external_id")


@query(" SELECT label AS external_id, count(*) AS n FROM e GROUP BY label HAVING count(*) > 1")
def l8_repeated_ids(spark, d):
    return L.repeated_ids(embeddings(spark, d).select("id", F.col("label").alias("external_id")))


# --- evaluation ------------------------------------------------------------------------------------------------------

RANKED = ", a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (" + SCORES[IP] + ")::FLOAT DESC, id) AS rank FROM q, e) t WHERE rank <= 10), t AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (" + SCORES[L2] + ")::FLOAT, id) AS rank FROM q, e) t WHERE rank <= 10), h AS (SELECT t.query_id, count(a.id) AS hits, count(*) AS n FROM t LEFT JOIN a ON t.query_id = a.query_id AND t.id = a.id GROUP BY t.query_id)"


def two_rankings(spark, d):
    e = embeddings(spark, d)
    return X.topk(e.select("id", "vec"), asked(e), 10, IP), X.topk(e.select("id", "vec"), asked(e), 10, L2)


@query(RANKED + " SELECT query_id, round(hits / least(n, 10), 6) AS recall FROM h")
def e1_recall(spark, d):
    return E.recall(*two_rankings(spark, d), 10).select("query_id", F.round("recall", 6).alias("recall"))


@query(RANKED + " SELECT round(coalesce(avg(hits / least(n, 10)), 0), 6) AS mean_recall FROM h")
def e2_mean_recall(spark, d):
    return E.mean_recall(E.recall(*two_rankings(spark, d), 10)).select(F.round("mean_recall", 6).alias("mean_recall"))


@query(RANKED + " SELECT query_id, round(hits / 10, 6) AS recall FROM h WHERE n >= 10")
def e3_distinct_recall(spark, d):
    return E.distinct_recall(*two_rankings(spark, d), 10).select("query_id", F.round("recall", 6).alias("recall"))


@query(RANKED + " SELECT query_id, round(hits / 10, 6) AS recall FROM h")
def e4_recall_over_k(spark, d):
    return E.recall(*two_rankings(spark, d), 10, divide_by_k=True).select("query_id", F.round("recall", 6).alias("recall"))


RUNS = "r AS (SELECT (user_id % 40)::BIGINT AS point, round(0.8 + (user_id % 40) / 200.0, 4) AS recall, round(1000 - 20 * (user_id % 40) + value, 2) AS qps FROM events)"


def runs(spark, d):
    """Trial-like rows from the event table: 40 points, the value as noise."""
    p = F.col("user_id") % 40
    return spark.read.parquet(f"{d}/events.parquet").select(p.cast("long").alias("point"), F.round(0.8 + p / 200.0, 4).alias("recall"), F.round(1000 - 20 * p + F.col("value"), 2).alias("qps"))


@query(", " + RUNS + " SELECT point, round(quantile_cont(recall, 0.5), 5) AS recall, round(quantile_cont(qps, 0.5), 3) AS qps FROM r GROUP BY point")
def e5_sweep_medians(spark, d):
    points, _ = E.sweep_medians(runs(spark, d), 0.9)
    return points.select("point", F.round("recall", 5).alias("recall"), F.round("qps", 3).alias("qps"))


@query(", " + RUNS + ", b AS (SELECT recall, max(qps) AS qps FROM r GROUP BY recall), f AS (SELECT recall, qps, max(qps) OVER (ORDER BY recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b) SELECT recall, qps FROM f WHERE above IS NULL OR qps > above")
def e6_frontier(spark, d):
    return E.frontier(runs(spark, d))


@query(", l AS (SELECT (abs(value) * 1000)::BIGINT AS ns FROM events) SELECT count(*) AS samples, round(avg(ns) / 1000, 4) AS mean_us, round(quantile_cont(ns, 0.5) / 1000, 4) AS p50_us, round(quantile_cont(ns, 0.95) / 1000, 4) AS p95_us, round(quantile_cont(ns, 0.99) / 1000, 4) AS p99_us, max(ns) / 1000 AS max_us, count(*) FILTER (ns = 0) AS zeros FROM l")
def e7_latency(spark, d):
    ns = spark.read.parquet(f"{d}/events.parquet").select(F.round(F.abs("value") * 1000).cast("long").alias("ns"))
    r = lambda c: F.round(c, 4).alias(c)
    return E.latency_summary(ns).select("samples", r("mean_us"), r("p50_us"), r("p95_us"), r("p99_us"), "max_us", "zeros")


@query(", " + SELF_KNN + ", s AS (SELECT node, rank, dist, round(lead(dist) OVER (PARTITION BY node ORDER BY rank) / nullif(dist, 0), 9) AS ratio FROM knn), m AS (SELECT node, max(ratio) AS ratio, max(dist) - min(dist) AS span FROM s GROUP BY node) SELECT node, min(rank) FILTER (s.ratio = m.ratio) AS cliff_rank, round(any_value(m.ratio), 4) AS ratio, round(any_value(span), 4) AS span FROM s JOIN m USING (node) GROUP BY node")
def e11_cliffs(spark, d):
    return E.cliffs(knn(embeddings(spark, d))).select("node", "cliff_rank", F.round("ratio", 4).alias("ratio"), F.round("span", 4).alias("span"))


@query(", " + SELF_KNN + ", g AS (SELECT node, id, row_number() OVER (PARTITION BY node ORDER BY id) AS rank FROM knn), m AS (SELECT greatest(g.rank, knn.rank) AS pos FROM g JOIN knn USING (node, id)) SELECT k, round((SELECT count(*) FROM m WHERE pos <= k + 1) / (SELECT count(DISTINCT node) FROM knn) / (k + 1), 6) AS precision FROM range(0, 10) t(k)")
def e12_rank_precision(spark, d):
    truth = knn(embeddings(spark, d))
    edges = truth.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("id")))
    return E.rank_precision(edges, truth, 10).select("k", F.round("precision", 6).alias("precision"))


@query(" SELECT count(*) * max(len(vec)) * 4 AS base, count(*) * 4 * (64 + 16 + 4) AS graph FROM e")
def e16_preflight(spark, d):
    s = embeddings(spark, d).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    p = E.preflight(s["n"], s["d"])
    return spark.createDataFrame([(p["base"], p["graph"])], "base long, graph long")


# --- adaptivity and calibration, over the event table as a trace: a user's events in order are the steps of a walk -------

HOPS = "hops AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, (length(event_type) % 2)::INT AS admitted FROM events)"


def hops(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.select(F.col("user_id").alias("query_id"), (F.row_number().over(by) - 1).cast("long").alias("step"), (F.length("event_type") % 2).alias("admitted"))


CONVERGED = ", " + HOPS + ", fed AS (SELECT *, coalesce(lag(admitted) OVER (PARTITION BY query_id ORDER BY step), 1) AS fed FROM hops), c AS (SELECT query_id, step, admitted, row_number() OVER w >= 10 AND sum(fed) OVER (PARTITION BY query_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5 < 0.5 AS converged FROM fed WINDOW w AS (PARTITION BY query_id ORDER BY step))"


@query(CONVERGED + " SELECT query_id, step, converged FROM c")
def a7_convergence(spark, d):
    return E.converged_steps(hops(spark, d), 5, 0.5).select("query_id", "step", "converged")


@query(CONVERGED + ", i AS (SELECT *, converged AND admitted = 0 AS idle FROM c), g AS (SELECT *, sum((NOT idle)::INT) OVER (PARTITION BY query_id ORDER BY step) AS island FROM i), r AS (SELECT query_id, step, row_number() OVER (PARTITION BY query_id, island ORDER BY step) AS run FROM g WHERE idle) SELECT query_id, min(step) AS exit_step FROM r WHERE run >= 2 GROUP BY query_id")
def a8_early_exit(spark, d):
    return E.early_exits(E.converged_steps(hops(spark, d), 5, 0.5), 2)


GAPS = ", " + HOPS + ", g AS (SELECT query_id, step - lag(step) OVER (PARTITION BY query_id ORDER BY step) AS gap FROM hops WHERE admitted = 1)"


def trace(spark, d):
    """The walk's trace: a step brings in its own number as an id, and the top are all that came."""
    h = hops(spark, d)
    by = Window.partitionBy("query_id")
    came = F.when(F.col("admitted") == 1, F.array("step")).otherwise(F.array().cast("array<long>"))
    top = F.when(F.col("step") == 0, F.flatten(F.collect_list(came).over(by))).otherwise(F.array().cast("array<long>"))
    return h.select("query_id", "step", (F.col("admitted") == 1).alias("admitted"), came.alias("ids"), top.alias("top"), F.count("*").over(by).alias("total_steps"))


@query(GAPS + " SELECT query_id, gap, 'useful' AS kind FROM g WHERE gap IS NOT NULL UNION ALL SELECT query_id, count(*) - max(step) FILTER (admitted = 1), 'tail' FROM hops GROUP BY query_id HAVING count(*) FILTER (admitted = 1) > 0")
def c2_useful_gaps(spark, d):
    from vectide.operators.calibration import useful_gaps

    return useful_gaps(trace(spark, d)).select("query_id", F.col("gap").cast("long").alias("gap"), "kind")


@query(GAPS + ", s AS (SELECT list(gap ORDER BY gap) AS v FROM g WHERE gap IS NOT NULL) SELECT coalesce(v[least(len(v) * 95 // 100, len(v) - 1) + 1], 0) AS p95, greatest(3, coalesce(v[least(len(v) * 95 // 100, len(v) - 1) + 1], 0)) AS early_exit_limit FROM s")
def c3_c6_gap_percentile(spark, d):
    from vectide.operators.calibration import percentile, useful_gaps

    p = percentile(useful_gaps(trace(spark, d)).where("kind = 'useful'"), "gap", 95)
    return p.select(F.col("p95").cast("long").alias("p95"), F.greatest(F.lit(3), "p95").cast("long").alias("early_exit_limit"))


CURVE = ", " + HOPS + ", r AS (SELECT step, avg(admitted) AS rate FROM hops GROUP BY step), sm AS (SELECT step, avg(rate) OVER (ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM r)"


@query(CURVE + " SELECT step, round(smoothed, 6) AS smoothed FROM sm")
def c4_smoothed_rates(spark, d):
    from vectide.operators.calibration import rates, smoothed_rates

    return smoothed_rates(rates(trace(spark, d)), 5).select("step", F.round("smoothed", 6).alias("smoothed"))


@query(CURVE + ", dv AS (SELECT step, smoothed, lead(smoothed) OVER (ORDER BY step) - smoothed AS slope, count(*) OVER () AS n FROM sm) SELECT round(greatest(0.05, least(0.25, coalesce(arg_min(smoothed, step) FILTER (n > 15 AND step >= 10 AND abs(slope) < 0.003 AND smoothed < 0.25), 0.15))), 6) AS threshold FROM dv")
def c5_threshold(spark, d):
    from vectide.operators.calibration import rates, smoothed_rates, threshold

    return threshold(smoothed_rates(rates(trace(spark, d)), 5), 5).select(F.round("threshold", 6).alias("threshold"))


# --- graph search: recall by the exact result ---------------------------------------------------------------------------


def built(spark, d, metric=L2, cascade=None):
    from vectide.index import Index

    e = embeddings(spark, d)
    index = Index(spark, e.select("id", "vec"), metric, G.GraphConfig(degree=16, build_l=40), cascade)
    index.calibrate(asked(e), k=10)
    return e, index


@query(" SELECT count(*) AS queries, true AS recalled FROM q")
def a1_graph_search(spark, d):
    """Adaptive search of a built and calibrated graph: a mean recall of 0.95 by exact search."""
    e, index = built(spark, d)
    found = index.search_table(asked(e), k=10, search_list_size=200)
    recall = E.recall(found, index.search_exact(asked(e)), 10)
    return recall.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.95).alias("recalled"))


@query()
def c1_calibration(spark, d):
    from dataclasses import asdict

    _, index = built(spark, d, COSINE)
    return spark.createDataFrame([asdict(index.calibration(10))], "k int, search_list_size int, samples int, threshold double, early_exit_limit int")


@query()
def e9_search_trace(spark, d):
    e, index = built(spark, d, IP)
    return index.trace(asked(e), k=10, search_list_size=48)


@query(" SELECT count(*) AS nodes, 16 * count(*) AS edges, 16 AS min_degree, 16 AS max_degree, 16.0::DOUBLE AS avg_degree FROM e")
def g1_graph_build(spark, d):
    """The degrees of a built graph: nodes are saturated."""
    e = embeddings(spark, d)
    return G.stats(G.build(e.select("id", "vec"), G.GraphConfig(degree=16, build_l=40, passes=1))).select("nodes", "edges", "min_degree", "max_degree", F.round("avg_degree", 4).alias("avg_degree"))
