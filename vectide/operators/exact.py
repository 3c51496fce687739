"""Exact search (X1-X6) and rescoring.

Two plans with the same result. `topk_expr` is Catalyst only: each query against each row, scored by expressions, the
k best kept by a window whose limit Spark pushes below the shuffle. `topk` is the one for volume: rows flow as Arrow
batches past a block of queries, NumPy scores them as matrix products of bounded size, each task keeps k rows per query,
and only these are shuffled. Queries go out in blocks of bounded size, whatever their number.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectide.errors import require
from vectide.functions.vectors import COSINE, L2, cosine_by, dot, metric_of, norm, rank_key, score
from vectide.session import share_code

#: Bytes of a block of queries that is sent to every task.
QUERY_BLOCK_BYTES = 16 << 20

#: Coordinates that meet in pairs of a query and a row, beyond which expressions, interpreted one by one, take minutes of many cores.
EXPR_WORK = 500_000_000

#: Scores and rows of a tile, in which a task's queries meet its rows, and queries whose results leave it at once.
SCORES_AT_ONCE, ROWS_AT_ONCE, RESULTS_AT_ONCE = 1 << 20, 4096, 8192


def check_search(k: int, rows: int | None = None) -> None:
    require(k >= 1, "search", "k must be positive", k=k)
    require(rows is None or k <= rows, "search", "k exceeds the number of rows", k=k, rows=rows)


def topk_expr(base: DataFrame, queries: DataFrame, k: int, metric: str = L2) -> DataFrame:
    """(query_id, rank, id, score) of base(id, vec) for queries(query_id, vec); for a block of queries and EXPR_WORK, more go through topk."""
    metric = metric_of(metric)
    check_search(k)
    size = query_bytes(queries)
    if size > QUERY_BLOCK_BYTES or size // 8 * base.count() > EXPR_WORK:
        return topk(base, queries, k, metric)
    # lengths are taken once a row and not once a pair, and a pair is scored once: what has no score is ranked last and left out then
    of = lambda df, key, v, n: df.select(key, F.col("vec").alias(v), *([norm("vec").alias(n)] if metric == COSINE else []))
    pairs = of(base, "id", "v", "v_norm").crossJoin(F.broadcast(of(queries, "query_id", "q", "q_norm")))
    value = cosine_by(dot("q", "v"), F.col("q_norm") * F.col("v_norm")) if metric == COSINE else score(metric, "q", "v")
    scored = pairs.select("query_id", "id", value.alias("score"))
    by = Window.partitionBy("query_id").orderBy(rank_key(metric, F.col("score")).asc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where((F.col("rank") <= k) & F.col("score").isNotNull()).select("query_id", "rank", "id", "score")


def query_bytes(queries: DataFrame) -> int:
    r = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    return r["n"] * (r["d"] or 0) * 8


def blocks_of(queries: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries as (ids, matrix) blocks of at most QUERY_BLOCK_BYTES, streamed to the driver; for queries of a checked size."""
    out, ids, rows, size = [], [], [], 0
    for r in queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).orderBy("query_id").toLocalIterator():
        require(r["vec"] is not None and all(x is not None and np.isfinite(x) for x in r["vec"]), "search", "query is null or not finite", query_id=r["query_id"])
        require(not rows or len(r["vec"]) == len(rows[0]), "search", "queries differ in dimension", query_id=r["query_id"])
        ids.append(r["query_id"])
        rows.append(r["vec"])
        size += 8 * len(r["vec"])
        if size >= QUERY_BLOCK_BYTES:
            out.append((np.array(ids, np.int64), np.array(rows)))
            ids, rows, size = [], [], 0
    return out + ([(np.array(ids, np.int64), np.array(rows))] if rows else [])


def scores_of(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of queries against rows, in double precision."""
    p = q @ x.T
    if metric == L2:
        # the expansion loses digits where rows are near; those few are summed again, directly
        whole = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
        p *= -2
        d = np.maximum(np.add(p, whole, out=p), 0.0, out=p)
        whole *= 1e-4
        i, j = np.nonzero(d < whole)
        d[i, j] = ((q[i] - x[j]) ** 2).sum(1)
        return d
    if metric == COSINE:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.clip(p / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]), -1.0, 1.0)
    return p


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; all lists must be of one length."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    require(n == 0 or len(flat) % n == 0, "search", "rows differ in dimension")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _merge(top: tuple[np.ndarray, ...], sure: np.ndarray, row: np.ndarray, s: np.ndarray, key: np.ndarray, k: int) -> None:
    """Puts rows of scores s and keys into the best of some queries, in place: top is (keys, ids, scores), sure how many of each count."""
    cut = np.where(sure == k, top[0][:, -1], np.inf).astype(key.dtype)
    if key.shape[1] > k:  # no more than the k best of these rows can stay, with what ties with the k-th
        cut = np.minimum(cut, np.partition(key, k - 1, axis=1)[:, k - 1]) if (sure < k).any() else cut
    i, j = np.nonzero((key <= cut[:, None]) & np.isfinite(key))
    if not len(i):
        return
    hit = np.unique(i)  # only queries that a row is near enough to are sorted again
    kept = np.arange(k) < sure[hit][:, None]
    of = np.concatenate([np.nonzero(kept)[0], np.searchsorted(hit, i)])
    every = [np.concatenate([t[hit][kept], new]) for t, new in zip(top, (key[i, j], row[j], s[i, j]), strict=True)]
    order = np.lexsort((every[1], every[0], of))
    n = np.bincount(of, minlength=len(hit))
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    order, place = order[place < k], place[place < k]
    for t, e in zip(top, every, strict=True):
        t[hit[of[order]], place] = e[order]
    sure[hit] = np.minimum(n, k)


def _best(metric: str, k: int, block, key_type=np.float32):
    ids, q = block
    sign = 1.0 if metric == L2 else -1.0

    def batches(stream):
        top = np.full((len(ids), k), np.inf, key_type), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))
        sure = np.zeros(len(ids), np.int64)
        for b in stream:
            if not b.num_rows:
                continue
            x, row = matrix_of(b.column("vec")), b.column("id").to_numpy()
            require(x.shape[1] == q.shape[1], "search", "query dimension differs from the rows'", query=q.shape[1], rows=x.shape[1])
            for c in range(0, len(row), ROWS_AT_ONCE):  # queries and rows meet in tiles, so scores take a bounded matrix
                part, step = x[c : c + ROWS_AT_ONCE], max(1, SCORES_AT_ONCE // min(len(row), ROWS_AT_ONCE))
                for a in range(0, len(ids), step):
                    s = scores_of(metric, q[a : a + step], part)
                    key = (sign * s).astype(key_type) + key_type(0)
                    key[np.isnan(key)] = np.inf
                    _merge(tuple(t[a : a + step] for t in top), sure[a : a + step], row[c : c + ROWS_AT_ONCE], s, key, k)
        for a in range(0, len(ids), RESULTS_AT_ONCE):
            ok = np.arange(k) < sure[a : a + RESULTS_AT_ONCE, None]
            own = np.broadcast_to(ids[a : a + RESULTS_AT_ONCE, None], ok.shape)[ok]
            key, found, value = (t[a : a + RESULTS_AT_ONCE][ok] for t in top)
            yield pa.record_batch([pa.array(own), pa.array(found), pa.array(value), pa.array(key.astype(np.float64))], ["query_id", "id", "score", "key"])

    return batches


FOUND = "query_id long, id long, score double, key double"


def _grid(rows: DataFrame, queries: DataFrame, k: int, metric: str, key_type, size: int) -> DataFrame:
    """FOUND rows of more queries than a block: parts of the rows meet blocks of the queries, each pair of them in a task."""
    spark = rows.sparkSession
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    bad = F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vec", lambda x: x != 0) if metric == COSINE else F.lit(False)
    first = q.where(F.coalesce(bad, F.lit(True)) | zero).first()
    require(first is None, "search", "query is null, not finite, or zero under cosine", query_id=first and first["query_id"])
    shape = q.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    require(shape["a"] == shape["b"], "search", "queries differ in dimension")
    blocks = -(-size // QUERY_BLOCK_BYTES) * 2  # half full on average, as hashes deal them out
    parts = max(1, -(-rows.count() * shape["b"] * 8 // QUERY_BLOCK_BYTES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = q.withColumn("block", deal("query_id", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = rows.withColumn("part", deal("id", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            y = y.combine_chunks()
            block = (y.column("query_id").to_numpy(), matrix_of(y.column("vec").combine_chunks()))
            out = list(_best(metric, k, block, key_type)(x.to_batches(max_chunksize=4096)))
        return pa.Table.from_batches(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "key": pa.array([], pa.float64())})

    share_code(spark)
    return held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(best, FOUND)


def topk(base: DataFrame, queries: DataFrame, k: int, metric: str = L2, whole_keys: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of base(id, vec) for each of queries(query_id, vec); ties to the lower id.

    Rows whose score is not finite (a zero vector under cosine) are left out; fewer than k rows give fewer ranks. Ranks are
    by the score in single precision, or as it is with `whole_keys`. One block of queries goes to every task; more of them
    stay on the executors and meet the rows in a grid of blocks.
    """
    metric = metric_of(metric)
    check_search(k)
    share_code(base.sparkSession)
    rows = base.select(F.col("id").cast("long").alias("id"), F.col("vec").alias("vec")).where("vec is not null")
    key_type = np.float64 if whole_keys else np.float32
    size = query_bytes(queries)
    blocks = blocks_of(queries) if size <= QUERY_BLOCK_BYTES else []
    for ids, q in blocks:
        require(metric != COSINE or bool((q != 0).any(axis=1).all()), "search", "zero query under cosine", query_id=int(ids[np.argmin((q != 0).any(axis=1))]))
    if not size:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    parts = [rows.mapInArrow(_best(metric, k, block, key_type), FOUND) for block in blocks]
    by = Window.partitionBy("query_id").orderBy("key", "id")
    best = (reduce(DataFrame.union, parts) if parts else _grid(rows, queries, k, metric, key_type, size)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "score")


def topk_of_subset(base: DataFrame, ids: DataFrame, queries: DataFrame, k: int, metric: str = L2) -> DataFrame:
    """X1 over the rows named by ids(id)."""
    return topk(base.join(ids.select("id"), "id", "left_semi"), queries, k, metric)


def check_subset(ids: list[int], rows: int) -> None:
    """What a subset given as a list must be: strictly ascending, and within the table."""
    require(all(a < b for a, b in zip(ids, ids[1:])), "search", "subset ids must be sorted and unique")
    require(not ids or 0 <= ids[0] and ids[-1] < rows, "search", "subset id out of range")


def with_scores(found: DataFrame, base: DataFrame, queries: DataFrame, metric: str = L2) -> DataFrame:
    """found(query_id, rank, id) with scores; never reorders."""
    q = queries.select("query_id", F.col("vec").alias("q"))
    v = base.select("id", F.col("vec").alias("v"))
    return found.select("query_id", "rank", "id").join(v, "id").join(q, "query_id").select("query_id", "rank", "id", score(metric, "q", "v").alias("score"))


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = L2, beam: int | None = None) -> DataFrame:
    """The first min(2k, beam) of candidates(query_id, rank, id) rescored exactly, ordered by (distance, id), cut to k."""
    first = candidates.where(F.col("rank") <= min(2 * k, beam or 2 * k))
    scored = with_scores(first, base, queries, metric)
    by = Window.partitionBy("query_id").orderBy(rank_key(metric, F.col("score")), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def self_knn(base: DataFrame, k: int, metric: str = L2, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score) of each row's nearest others; queries: the rows to ask for (all by default)."""
    asked = (queries if queries is not None else base).select(F.col("id").alias("query_id"), "vec")
    found = topk(base, asked, k + 1, metric).where("id <> query_id")
    by = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def random_base(spark, rows: int, dim: int = 128, seed: int = 42, high: float = 10.0) -> DataFrame:
    """base(id, vec) of uniform coordinates in [0, high); the same for the same seed and partitioning."""
    return spark.range(rows).select("id", F.array(*[(F.rand(seed + d) * high).cast("float") for d in range(dim)]).alias("vec"))
