"""Baselines to compare a graph with (E17): inverted lists with product codes, and a layered graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vectide.functions.vectors import L2, metric_of, rank_key
from vectide.operators import exact
from vectide.operators.graph import GraphConfig, assign_shards, greedy_search, pair_distances, robust_prune
from vectide.operators.ivf import Ivf, assign
from vectide.operators.quantizers import ProductCode
from vectide.session import share_code


def ivf_pq_search(base: DataFrame, queries: DataFrame, k: int, lists: int = 64, probes: int = 8, centres: int = 256, metric: str = L2, refine: int = 4) -> DataFrame:
    """(query_id, rank, id, score): lists of residuals in product codes; the best `refine` * k by estimate are scored exactly."""
    metric = metric_of(metric)
    spark = share_code(base.sparkSession)
    index = Ivf.build(base, lists, metric)
    coarse = spark.sparkContext.broadcast(index.centres)

    def residual(frames):
        for f in frames:
            x = np.stack(f["vec"].to_numpy()).astype(np.float64) if len(f) else np.zeros((0, 1))
            yield pd.DataFrame({"list": f["list"], "id": f["id"], "vec": list(x - coarse.value[f["list"].to_numpy()]) if len(f) else []})

    left = index.rows.mapInPandas(residual, "list int, id long, vec array<double>")
    book = ProductCode.fit(left.select("id", "vec"), centres=centres)
    coded = left.select("id", "list").join(book.encode_table(left.select("id", "vec")), "id")
    asked = assign(queries, index.centres, probes, "query_id").select("query_id", F.col("vec").cast("array<double>").alias("q"), F.explode("lists").alias("list"))

    def estimate(rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            codes, ids, centre = np.stack(rows["code"].to_numpy()), rows["id"].to_numpy(), coarse.value[int(rows["list"].iloc[0])]
            for qid, v in zip(q["query_id"], q["q"], strict=True):
                v = np.asarray(v)
                d = book.estimate(book.lookup(v - centre), codes) if metric == L2 else book.estimate(book.lookup(v, True), codes) - centre @ v
                best = np.lexsort((ids, d))[: refine * k]
                out.append(pd.DataFrame({"query_id": qid, "id": ids[best], "estimate": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "estimate": []})

    found = coded.groupBy("list").cogroup(asked.groupBy("list")).applyInPandas(estimate, "query_id long, id long, estimate double")
    by = Window.partitionBy("query_id").orderBy("estimate", "id")
    first = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= refine * k)
    scored = exact.with_scores(first, base, queries, metric)
    last = Window.partitionBy("query_id").orderBy(rank_key(metric, F.col("score")), "id")
    return scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def layers_of(x: np.ndarray, degree: int, width: int, metric: str = L2, seed: int = 42) -> tuple[list[list[list[int]]], int]:
    """Layers of edges, the lowest with all rows and each higher one with a `degree`-th of those below, and the entry."""
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(max(degree, 2))).astype(int), 12)
    layers = [[[] for _ in range(len(x))] for _ in range(int(level.max()) + 1)]
    entry, top = 0, int(level[0])

    def prune(node: int, pool: list[int]) -> list[int]:
        ids = np.array(sorted(set(pool) - {node}))
        d = pair_distances(metric, x[[node]], x[ids])[0]
        order = np.lexsort((ids, d))
        return robust_prune(ids[order], d[order], pair_distances(metric, x[ids[order]], x[ids[order]]), degree, 1.0, node)[0]

    for node in range(1, len(x)):
        at = entry
        for layer in range(top, int(level[node]), -1):
            at = greedy_search(x, layers[layer], at, x[node], 1, metric)[0][0]
        for layer in range(min(top, int(level[node])), -1, -1):
            found = greedy_search(x, layers[layer], at, x[node], width, metric)[0][:width]
            layers[layer][node] = prune(node, found)
            for other in layers[layer][node]:
                own = [*layers[layer][other], node]
                layers[layer][other] = own if len(own) <= 2 * degree else prune(other, own)
            at = found[0]
        if level[node] > top:
            entry, top = node, int(level[node])
    return layers, entry


def hnsw_search(base: DataFrame, queries: DataFrame, k: int, degree: int = 16, build_width: int = 64, width: int = 64, metric: str = L2, shard_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, id, score): a layered graph for each shard of bounded size, all queries against each, merged by score."""
    metric = metric_of(metric)
    share_code(base.sparkSession)
    shards = assign_shards(base, GraphConfig(shard_rows=shard_rows), overlap=1)
    number = shards.select(F.col("shard").alias("to")).distinct()
    asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).crossJoin(number)  # as often as there are shards

    def search(rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            rows = rows.sort_values("id")
            x, ids = np.stack(rows["vec"].to_numpy()).astype(np.float64), rows["id"].to_numpy()
            layers, entry = layers_of(x, degree, build_width, metric)
            for qid, v in zip(q["query_id"], q["vec"], strict=True):
                v, at = np.asarray(v), entry
                for layer in range(len(layers) - 1, 0, -1):
                    at = greedy_search(x, layers[layer], at, v, 1, metric)[0][0]
                found = np.array(greedy_search(x, layers[0], at, v, max(width, k), metric)[0][: max(width, k)])
                s = exact.scores_of(metric, v[None], x[found])[0]
                best = np.lexsort((ids[found], s if metric == L2 else -s))[:k]
                out.append(pd.DataFrame({"query_id": qid, "id": ids[found[best]], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = shards.groupBy("shard").cogroup(asked.groupBy("to")).applyInPandas(search, "query_id long, id long, score double")
    by = Window.partitionBy("query_id").orderBy(rank_key(metric, F.col("score")), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
