"""Proximity graphs (G1-G16): construction per shard, shard merge, zones, entries, statistics and invariants.

A graph is a table graph(node, local, remote, extra). A shard of bounded size is built by NumPy in one task, for many nodes at
once, and the shards run in parallel. Shards come from coarse centres fitted on a bounded sample; every row goes to its two
nearest, and the edges of both are united and cut, which joins the shards into one graph.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectide.errors import require
from vectide.functions.vectors import IP, L2, dot, metric_of, squared_l2
from vectide.operators.quantizers import kmeans, nearest
from vectide.session import share_code, work_folder

#: How often at most a graph is gone through for rows that their own searches miss.
ROUNDS = 24

#: Bytes of rows and edges up to which these are shared with every task.
SHARED_BYTES = 1 << 30

#: Scores of rows with all rows, pools that are pruned, and searches that a task holds at once.
BLOCK_SCORES, PRUNED_AT_ONCE, ASKED_AT_ONCE = 1 << 22, 256, 256

SCHEMA = "node long, local array<long>, remote array<long>, extra array<long>"


@dataclass(frozen=True)
class GraphConfig:
    """degree >= 1, build_l >= degree, alpha >= 1 and finite, local_pct in 1..100; shard_rows bounds what one task builds."""

    degree: int = 64
    build_l: int = 100
    alpha: float = 1.2
    max_extra: int = 16
    local_pct: int = 60
    passes: int = 2
    saturate: bool = True
    shard_rows: int = 20_000

    def check(self) -> GraphConfig:
        require(self.degree >= 1, "graph", "degree must be positive", degree=self.degree)
        require(self.build_l >= self.degree, "graph", "build_l must be at least degree", build_l=self.build_l)
        require(self.alpha >= 1 and np.isfinite(self.alpha), "graph", "alpha must be finite and at least 1", alpha=self.alpha)
        require(1 <= self.local_pct <= 100 and self.max_extra >= 0 and self.passes >= 1, "graph", "local_pct must be in 1..100")
        return self


def pair_distances(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Build distances: squared L2, or minus the inner product moved to be positive; cosine rows arrive normalised."""
    if metric == L2:
        return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)
    if metric == "cosine":
        return np.clip(1 - x @ y.T, 0.0, 2.0)
    return -(x @ y.T)


def robust_prune(pool_ids: np.ndarray, pool_dist: np.ndarray, between: np.ndarray, degree: int, alpha: float, node: int, deleted=frozenset(), saturate: bool = False) -> tuple[list[int], list[int]]:
    """(kept ids, ids that were occluded) of a pool sorted by distance to node.

    between: distances among the pool. Kept are those that no kept one occludes at the current slack, which grows from 1
    to alpha by steps of 1.2; a later j gets the factor max(own, d(node, j) / d(i, j)) from each kept i.
    """
    n = len(pool_ids)
    factor, kept, candidates = np.zeros(n), [], []
    slack = 1.0
    while slack <= alpha and len(kept) < degree:
        for i in range(n):
            if len(kept) >= degree:
                break
            if factor[i] > slack:
                continue
            factor[i] = np.inf
            if pool_ids[i] != node and int(pool_ids[i]) not in deleted:
                kept.append(int(pool_ids[i]))
            later = np.arange(i + 1, n)
            later = later[factor[i + 1 :] <= alpha]
            if len(later):
                d = between[i, later]
                with np.errstate(divide="ignore", invalid="ignore"):
                    new = np.where(d == 0, np.inf, np.maximum(factor[later], pool_dist[later] / d))
                crossed = later[(new > alpha)]
                candidates += [int(pool_ids[j]) for j in crossed]
                factor[later] = new
        slack *= 1.2
    if saturate and alpha > 1:
        seen = set(kept)
        for i in pool_ids.tolist():
            if len(kept) >= degree:
                break
            if i != node and i not in seen:
                kept.append(i)
                seen.add(i)
    return kept, candidates


def greedy_search(x: np.ndarray, edges: list[list[int]], entry: int, q: np.ndarray, beam: int, metric: str = L2) -> tuple[list[int], list[float]]:
    """Ids and distances of all rows expanded or held in a beam of the given width."""
    import bisect

    d0 = float(pair_distances(metric, q[None], x[[entry]])[0, 0])
    held, seen, done, expanded = [(d0, entry)], {entry}, set(), {}
    while True:
        at = next(((d, i) for d, i in held if i not in done), None)
        if at is None:
            break
        done.add(at[1])
        expanded[at[1]] = at[0]
        new = [j for j in edges[at[1]] if j not in seen]
        if new:
            seen.update(new)
            for d, j in zip(pair_distances(metric, q[None], x[new])[0].tolist(), new, strict=True):
                if len(held) < beam or d < held[-1][0]:
                    bisect.insort(held, (d, j))
                    del held[beam:]
    every = expanded | {i: d for d, i in held}
    order = sorted(every, key=lambda i: (every[i], i))
    return order, [every[i] for i in order]


def nearest_rows(x: np.ndarray, size: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of each row's `size` nearest others by (distance, id), among all; scores are taken a block of rows at a time."""
    n = len(x)
    size = min(size, n - 1)
    ids, dist = np.empty((n, size), np.int64), np.empty((n, size))
    step = max(1, BLOCK_SCORES // n)
    for a in range(0, n, step):
        d = pair_distances(metric, x[a : a + step], x)
        own = np.arange(len(d))
        d[own, a + own] = np.inf
        near = np.argpartition(d, size - 1, axis=1)[:, :size] if size else np.empty((len(d), 0), np.int64)
        d = np.take_along_axis(d, near, 1)
        order = np.lexsort((near, d), axis=1)
        ids[a : a + step], dist[a : a + step] = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    return ids, dist


def prune_all(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, config: GraphConfig, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """robust_prune of the pools of many nodes at once, one row each, without the node: which are kept, which were occluded."""
    rows = x[ids]
    product = rows @ rows.transpose(0, 2, 1)
    square = (rows * rows).sum(2)
    between = np.maximum(square[:, :, None] + square[:, None] - 2 * product, 0.0) if metric == L2 else np.clip(1 - product, 0.0, 2.0) if metric == "cosine" else -product
    n, size = ids.shape
    factor, kept, count, slack = np.zeros((n, size)), np.zeros((n, size), bool), np.zeros(n, np.int64), 1.0
    while slack <= config.alpha:
        for i in range(size):
            at = np.nonzero((factor[:, i] <= slack) & (count < config.degree))[0]
            kept[at, i], factor[at, i] = True, np.inf
            count[at] += 1
            d, later = between[at, i, i + 1 :], factor[at, i + 1 :]
            with np.errstate(divide="ignore", invalid="ignore"):
                new = np.where(d == 0, np.inf, np.maximum(later, dist[at, i + 1 :] / d))
            factor[at, i + 1 :] = np.where(later <= config.alpha, new, later)
        slack *= 1.2
    occluded = ~kept & (factor > config.alpha)
    if config.saturate and config.alpha > 1:
        free = ~kept
        kept |= free & (np.cumsum(free, axis=1) <= (config.degree - count)[:, None])
    return kept, occluded


def linked(ids: np.ndarray, own: list[list[int]], degree: int) -> list[list[int]]:
    """Edges from own ones and from what nodes are owed: links from the nearest of `ids` that have room, the least linked nodes
    first, one a turn; what room is left then goes to a node's own nearest.

    Without them, a node that is nobody's nearest loses the links back to it where those who are near to it are full.
    """
    edges = [dict.fromkeys(e) for e in own]
    links = np.bincount(np.array([j for e in own for j in e], np.int64), minlength=len(own))
    room = [degree - len(e) for e in own]
    for _ in range(degree // 2):
        for i in np.argsort(links, kind="stable").tolist():
            for j in ids[i].tolist() if links[i] < degree else ():
                if room[j] > 0 and i not in edges[j]:
                    edges[j][i] = None
                    room[j] -= 1
                    links[i] += 1
                    break
    for e, near in zip(edges, ids, strict=True):
        for j in near.tolist():
            if len(e) >= degree:
                break
            e[j] = None
    return [list(e) for e in edges]


def search_all(x: np.ndarray, edges: np.ndarray, entry: int, asked: np.ndarray, width: int, metric: str) -> np.ndarray:
    """greedy_search for the rows of many nodes at once, over edges padded by len(x): what each holds, nearest first, padded too."""
    n, square = len(x), (x * x).sum(1)
    held = np.full((len(asked), width), n, np.int32)
    for a in range(0, len(asked), ASKED_AT_ONCE):
        node = asked[a : a + ASKED_AT_ONCE]
        q, at = x[node], np.arange(len(node))
        seen = np.zeros((len(node), n + 1), bool)
        seen[:, [entry, n]] = True
        dist, ids, done = np.full((len(node), width), np.inf), np.full((len(node), width), n, np.int64), np.ones((len(node), width), bool)
        ids[:, 0], done[:, 0] = entry, False
        dist[:, 0] = pair_distances(metric, q, x[[entry]])[:, 0]
        while True:
            first = np.argmin(done[at], axis=1)
            open_ = ~done[at, first]
            at, first = at[open_], first[open_]
            if not len(at):
                break
            now = ids[at, first]
            done[at, first] = True
            near = edges[now]
            old = seen[at[:, None], near]
            seen[at[:, None], near] = True
            rows = np.minimum(near, n - 1)
            d = (x[rows] @ q[at][:, :, None])[:, :, 0]
            d = np.maximum(square[rows] + square[node[at]][:, None] - 2 * d, 0.0) if metric == L2 else np.clip(1 - d, 0.0, 2.0) if metric == "cosine" else -d
            d[old] = np.inf
            d, new, was = np.concatenate([dist[at], d], 1), np.concatenate([ids[at], np.where(old, n, near)], 1), np.concatenate([done[at], old], 1)
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            d, new, was = (np.take_along_axis(v, order, 1) for v in (d, new, was))
            if ((d[:, 1:] == d[:, :-1]) & (d[:, 1:] < np.inf)).any():  # equals stand by id
                order = np.lexsort((new, d), axis=1)
                d, new, was = (np.take_along_axis(v, order, 1) for v in (d, new, was))
            dist[at], ids[at], done[at] = d, new, was
        held[a : a + len(node)] = ids
    return held


def padded(edges: list[list[int]], width: int) -> np.ndarray:
    """Edges as a matrix, filled up with the number of nodes."""
    out, size = np.full((len(edges), max(width, 1)), len(edges), np.int32), np.array([len(e) for e in edges])
    out[np.arange(out.shape[1]) < size[:, None]] = [j for e in edges for j in e]
    return out


def shard_edges(x: np.ndarray, config: GraphConfig, metric: str = L2) -> tuple[list[list[int]], list[np.ndarray], list[int]]:
    """Edges and captured candidates of a shard's nodes, and how many of each node's edges, the first, are its own.

    A shard is small enough for all its rows to meet, so the pools that are pruned are those of the `build_l` nearest, which a
    search for each row would come near to; a second pass finds nothing more. Half the edges are a node's own, nearest first, the
    others lead to nodes that it is near to.
    """
    ids, dist = nearest_rows(x, config.build_l, metric)
    own, captured = [], []
    for a in range(0, len(x), PRUNED_AT_ONCE):
        near = ids[a : a + PRUNED_AT_ONCE]
        kept, occluded = prune_all(x, near, dist[a : a + PRUNED_AT_ONCE], config, metric)
        own += [i[k][: -(-config.degree // 2)].tolist() for i, k in zip(near, kept, strict=True)]
        captured += [i[k].astype(np.int32) for i, k in zip(near, occluded, strict=True)]
    return linked(ids, own, config.degree), captured, [len(e) for e in own]


def build_shard(x: np.ndarray, config: GraphConfig, metric: str = L2) -> tuple[list[list[int]], list[set[int]], int]:
    """Edges, captured candidates and entry of a shard whose nodes are all reached and found from the entry."""
    entry = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(1)))
    edges, captured, _ = shard_edges(x, config, metric)
    settle(x, edges, entry, config, metric)
    return edges, [set(c.tolist()) - set(e) for c, e in zip(captured, edges, strict=True)], entry


def settle(x: np.ndarray, edges: list[list[int]], entry: int, config: GraphConfig, metric: str, search=search_all) -> None:
    """Changes edges, within their degree, so that every node is reached from the entry, and is found where it is its own nearest."""
    parent = reach_all(x, edges, entry, config, metric)
    if metric != IP:
        find_all(x, edges, entry, config, metric, parent, search=search)


def reach_all(x: np.ndarray, edges: list[list[int]], entry: int, config: GraphConfig, metric: str) -> dict[int, int]:
    """Gives every node that no path leads to from the entry a link from one near it that a path leads to; by whom each is reached.

    Such a node takes the place of the farthest edge that isn't the only way to another; a node with room keeps all.
    """
    parent, found = {entry: entry}, [entry]

    def spread(front: list[int]) -> None:
        while front:
            front = [j for i in front for j in edges[i] if j not in parent and parent.setdefault(j, i) == i]
            found.extend(front)

    spread([entry])
    for node in range(len(x)):
        if node in parent:
            continue
        near, _ = greedy_search(x, edges, entry, x[node], config.build_l, metric)
        for i in [*near, *found]:
            if i == node or i not in parent:
                continue
            spare = [k for k, j in enumerate(edges[i]) if parent.get(j) != i]
            if len(edges[i]) >= config.degree:
                if not spare:
                    continue
                d = pair_distances(metric, x[[i]], x[[edges[i][k] for k in spare]])[0]
                del edges[i][spare[int(np.argmax(d))]]
            edges[i].append(node)
            parent[node] = i
            found.append(node)
            spread([node])
            break
    return parent


def find_all(x: np.ndarray, edges: list[list[int]], entry: int, config: GraphConfig, metric: str, parent: dict[int, int], rounds: int = ROUNDS, search=search_all) -> list[int]:
    """Lets a search of `build_l` for a node's own row find it, where a row is its own nearest; the nodes that the last round did not find.

    A path may lead to a node and no search take it. Such a node gets a link from the nearest that its search holds, in place of
    the farthest edge that neither reaches a node alone nor was given here. What that may have changed are searches which hold a
    node that lost an edge: these are made again with those for nodes not found, and in the end all, until all find their rows
    or `rounds` are over.
    """
    n, width, given, lost = len(x), config.build_l, set(), []
    ask, walked = np.arange(n), np.full((n, width), n, np.int32)

    def below(i: int, top: int) -> bool:
        while i not in (top, entry):
            i = parent[i]
        return i == top

    def spared(i: int, adjacent: np.ndarray) -> int | None:
        """The place of an edge of i that may go."""
        spare = [k for k, j in enumerate(edges[i]) if parent.get(j) != i and (i, j) not in given]
        if spare:
            d = pair_distances(metric, x[[i]], x[[edges[i][k] for k in spare]])[0]
            return spare[int(np.argmax(d))]
        for k, j in enumerate(edges[i]):  # a node that another one reaches too
            for p in np.nonzero((adjacent == j).any(1))[0].tolist() if (i, j) not in given else ():
                if p != i and j in edges[p] and p in parent and not below(p, j):
                    parent[j] = p
                    return k
        return None

    for _ in range(rounds):
        adjacent = padded(edges, config.degree)
        held = walked[ask] = search(x, adjacent, entry, ask, width, metric)
        found = (held == ask[:, None]).any(1)
        full = held[:, -1] < n
        found[full] |= (x[held[full, -1]] == x[ask[full]]).all(1)  # equal rows fill the beam
        lost, cut = ask[~found].tolist(), np.zeros(n + 1, bool)
        for node, order in zip(lost, held[~found].tolist(), strict=True):
            hosts = [i for i in order if i < n and node not in edges[i]]
            for i, other in [*((i, adjacent[:0]) for i in hosts), *((i, adjacent) for i in hosts)]:
                if len(edges[i]) >= config.degree:
                    k = spared(i, other)
                    if k is None:
                        continue
                    del edges[i][k]
                    cut[i] = True
                edges[i].append(node)
                given.add((i, node))
                break
        if not lost and len(ask) == n:
            break
        again = cut[walked].any(1)
        again[lost] = True
        ask = np.nonzero(again)[0] if again.any() else np.arange(n)
    return lost


def local_size(degree: int, pct: int = 60) -> int:
    return int(np.floor(pct / 100 * degree + 0.5))


def zones(edges: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Graph table of edges(node, id, dist, original): by distance, the first round(pct * degree) are local
    (originals) or extra; later originals are remote, later extras dropped; at most max_extra extras."""
    by = Window.partitionBy("node")
    near = by.orderBy("dist", "id")
    placed = edges.withColumn("degree", F.sum(F.col("original").cast("int")).over(by)).withColumn("rank", F.row_number().over(near))
    inside = F.col("rank") <= F.floor(F.lit(config.local_pct / 100) * F.col("degree") + 0.5)
    zone = F.when(inside & F.col("original"), "local").when(F.col("original"), "remote").when(inside, "extra")
    placed = placed.withColumn("zone", zone).where("zone is not null").withColumn("k", F.row_number().over(Window.partitionBy("node", "zone").orderBy("dist", "id")))
    placed = placed.where((F.col("zone") != "extra") | (F.col("k") <= config.max_extra))
    ids = lambda z: F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == z, F.struct("dist", "id")))), lambda s: s["id"]).alias(z)
    return placed.groupBy("node").agg(ids("local"), ids("remote"), ids("extra"))


def rank_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What a node's edges are ordered by, from the node's row to some rows; from many nodes' rows to one each."""
    return ((x - q) ** 2).sum(1) if metric == L2 else -(x * q).sum(1)


#: Kinds of edges while a graph is built: a node's own, those owed to others, and candidates that were occluded.
OWN, OWED, CAPTURED = 0, 1, 2


def _edges_of_shard(config: GraphConfig, metric: str, settled: bool):
    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        x, ids = np.stack(f["vec"].to_numpy()).astype(np.float64), f["id"].to_numpy()
        edges, captured, own = shard_edges(x, config, metric)
        if settled:
            settle(x, edges, int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(1))), config, metric)
        # an edge that is captured too stays what it is: the least kind of a pair counts
        frm = np.concatenate([np.repeat(np.arange(len(x)), [len(e) for e in part]) for part in (edges, captured)])
        to = np.concatenate([np.array([j for e in edges for j in e], np.int64), *captured]).astype(np.int64)
        first = np.concatenate([np.arange(len(e)) < k for e, k in zip(edges, own, strict=True)])
        kind = np.full(len(to), CAPTURED, np.int32)
        kind[: len(first)] = np.where(first, OWN, OWED)
        dist = [rank_distances(metric, x[frm[a : a + 65536]], x[to[a : a + 65536]]) for a in range(0, max(1, len(to)), 65536)]
        return pd.DataFrame({"node": ids[frm], "id": ids[to], "kind": kind, "dist": np.concatenate(dist)})

    return build


def assign_shards(base: DataFrame, config: GraphConfig, overlap: int = 2, sample: int = 20_000, seed: int = 42) -> DataFrame:
    """base(id, vec) with a shard, each row in its `overlap` nearest of so many centres that shards have shard_rows on average."""
    n = base.count()
    if n <= config.shard_rows:
        return base.select("id", "vec", F.lit(0).alias("shard"))
    shards = -(-n * overlap // config.shard_rows)
    rows = base.select(F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    centres = kmeans(np.array([r["vec"] for r in rows]), shards, seed=seed)

    def batches(frames):
        for f in frames:
            x = np.stack(f["vec"].to_numpy()).astype(np.float64)
            d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
            near = np.argsort(d, axis=1, kind="stable")[:, :overlap]
            yield pd.concat([f.assign(shard=near[:, k].astype(np.int32)) for k in range(near.shape[1])])

    return base.select("id", "vec").mapInPandas(batches, f"id long, vec {dict(base.dtypes)['vec']}, shard int")


def build(base: DataFrame, config: GraphConfig = GraphConfig(), metric: str = L2) -> DataFrame:
    """The graph of base(id, vec), written once to a folder that driver and executors share; cosine rows must be normalised.

    Shards overlap. Of the edges that two of them have for a node, its own and those owed to others stay in turn, nearest first.
    Where rows and edges can be shared with every task, the joined graph is then searched for all its rows from its entry, and
    changed until all are found; beyond that it is searched by shards, which are settled one by one.
    """
    config.check()
    metric = metric_of(metric)
    spark = share_code(base.sparkSession)
    base = base.select(F.col("id").cast("long").alias("id"), "vec")
    shape = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    one = shape["n"] <= config.shard_rows
    raw = assign_shards(base, config).groupBy("shard").applyInPandas(_edges_of_shard(config, metric, one), "node long, id long, kind int, dist double")
    edges = raw.groupBy("node", "id").agg(F.min("kind").alias("kind"), F.min("dist").alias("dist"))
    turn = F.row_number().over(Window.partitionBy("node", "kind").orderBy("dist", "id"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("kind") == CAPTURED, "turn", "kind"))
    edges = edges.withColumn("turn", turn).withColumn("place", place).where((F.col("kind") == CAPTURED) | (F.col("place") <= config.degree))
    edges = edges.select("node", "id", "dist", (F.col("kind") != CAPTURED).alias("original"))
    if not one and shared_bytes(shape["n"], shape["d"], config.degree) <= SHARED_BYTES:
        edges = settled(base, kept_table(edges), config, metric)
    every = base.select(F.col("id").alias("node")).join(zones(edges, config), "node", "left")
    empty = F.array().cast("array<long>")
    return kept_table(every.select("node", *[F.coalesce(c, empty).alias(c) for c in ("local", "remote", "extra")]))


def kept_table(df: DataFrame) -> DataFrame:
    """The table written to a shared folder and read again: what made it isn't run again for each use."""
    path = f"{work_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_bytes(rows: int, dim: int, degree: int) -> int:
    """What rows as doubles and their edges take in a task."""
    return rows * (dim * 8 + degree * 8)


def searched_by_tasks(spark, x: np.ndarray):
    """search_all by tasks that share the rows, each for some of the nodes asked for."""
    rows = spark.sparkContext.broadcast(x)

    def search(x: np.ndarray, edges: np.ndarray, entry: int, asked: np.ndarray, width: int, metric: str):
        if len(asked) <= 4 * ASKED_AT_ONCE:
            return search_all(x, edges, entry, asked, width, metric)
        shared, step = spark.sparkContext.broadcast((edges, asked)), 2 * ASKED_AT_ONCE

        def batches(stream):
            edges, asked = shared.value
            for b in stream:
                for k in b.column("id").to_pylist():
                    held = search_all(rows.value, edges, entry, asked[k * step : (k + 1) * step], width, metric)
                    yield pa.record_batch([pa.array([k]), pa.array([held.tobytes()], pa.binary())], ["k", "held"])

        parts = -(-len(asked) // step)
        found = sorted(spark.range(0, parts, 1, parts).mapInArrow(batches, "k long, held binary").collect())
        shared.destroy()
        return np.concatenate([np.frombuffer(r["held"], np.int32) for r in found]).reshape(-1, width)

    return search


def settled(base: DataFrame, edges: DataFrame, config: GraphConfig, metric: str) -> DataFrame:
    """edges(node, id, dist, original) with originals changed so that every node is reached and found from the row nearest to the mean."""
    spark = base.sparkSession
    rows = base.select("id", F.col("vec").cast("array<double>").alias("vec")).orderBy("id").toArrow()
    ids = rows.column("id").to_numpy()
    x = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    mine = edges.where("original").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "id"))), lambda s: s["id"]).alias("ids")).toArrow()
    lists = mine.column("ids").combine_chunks()
    to, ends = np.searchsorted(ids, lists.flatten().to_numpy()), np.cumsum(lists.value_lengths().to_numpy())
    out: list[list[int]] = [[] for _ in ids]
    for node, e in zip(np.searchsorted(ids, mine.column("node").to_numpy()).tolist(), np.split(to, ends[:-1]), strict=True):
        out[node] = e.tolist()
    settle(x, out, int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(1))), config, metric, searched_by_tasks(spark, x))
    size = np.array([len(e) for e in out])
    frm, to = np.repeat(np.arange(len(ids)), size), np.array([j for e in out for j in e], np.int64)
    dist = np.concatenate([rank_distances(metric, x[frm[a : a + 65536]], x[to[a : a + 65536]]) for a in range(0, max(1, len(frm)), 65536)])
    path = f"{work_folder(spark)}/settled"
    for a in range(0, max(1, len(frm)), 1 << 20):  # a piece at a time passes the driver's JVM
        piece = pa.table({"node": ids[frm[a : a + (1 << 20)]], "id": ids[to[a : a + (1 << 20)]], "dist": dist[a : a + (1 << 20)]})
        spark.createDataFrame(piece).write.mode("append").parquet(path)
    new = spark.read.schema("node long, id long, dist double").parquet(path)
    captured = edges.where("not original").join(new.select("node", "id"), ["node", "id"], "left_anti")
    return new.withColumn("original", F.lit(True)).unionByName(captured)


def insert(graph: DataFrame, base: DataFrame, new: DataFrame, config: GraphConfig = GraphConfig(), metric: str = L2) -> DataFrame:
    """The graph of base(id, vec) with new(id, vec) added as shards of their own, tied to the old rows they are nearest to.

    Old nodes that new ones link to get the links back and are pruned again, from their own edges and the `build_l` nearest
    of these. So are new nodes, from the edges among themselves and those to old rows.
    """
    from vectide.operators.exact import topk

    metric = metric_of(metric)
    share_code(base.sparkSession)
    base, new = (df.select(F.col("id").cast("long").alias("id"), "vec") for df in (base, new))
    fresh = build(new, config, metric)
    old = topk(base, new.select(F.col("id").alias("query_id"), "vec"), max(1, config.degree // 2), metric).select(F.col("query_id").alias("node"), "id", "rank")
    near = Window.partitionBy("node").orderBy("rank", "id")
    back = old.select(F.col("id").alias("node"), F.col("node").alias("id"), "rank").withColumn("k", F.row_number().over(near)).where(F.col("k") <= config.build_l).select("node", "id")
    touched = graph.join(back.select("node").distinct(), "node", "left_semi").unionByName(fresh)
    every = base.union(new)
    pool = edge_list(touched).union(back).union(old.select("node", "id")).distinct()
    pool = pool.join(every, "id").union(touched.select(F.col("node").alias("id"), "node").join(every, "id").select("id", "node", "vec"))

    def prune(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        node = int(key[0])
        x, ids = np.stack(f["vec"].to_numpy()).astype(np.float64), f["id"].to_numpy()
        d = rank_distances(metric, x[np.argmax(ids == node)], x)
        order = np.lexsort((ids, d))
        order = order[ids[order] != node]
        ids, x, d = ids[order], x[order], d[order]
        shift = 0.0 if metric == L2 else -min(0.0, float(d.min(initial=0.0)))  # occlusion compares ratios of what is positive
        kept, _ = robust_prune(ids, d + shift, pair_distances(metric, x, x), config.degree, config.alpha, node, saturate=config.saturate)
        first = max(1, local_size(len(kept), config.local_pct))
        at = {int(i): k for k, i in enumerate(ids)}
        kept.sort(key=lambda i: at[i])
        return pd.DataFrame({"node": [node], "local": [kept[:first]], "remote": [kept[first:]]})

    again = pool.groupBy("node").applyInPandas(prune, "node long, local array<long>, remote array<long>")
    empty = F.array().cast("array<long>")
    return graph.join(again, "node", "left_anti").unionByName(again.withColumn("extra", empty))


def suppress(found: DataFrame, deleted: DataFrame, k: int) -> DataFrame:
    """Results without deleted(id), ranked anew and cut to k."""
    left = found.join(deleted.select("id"), "id", "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k).select(*found.columns)


def edge_list(graph: DataFrame, zones_: tuple[str, ...] = ("local", "remote")) -> DataFrame:
    return graph.select("node", F.explode(F.concat(*zones_)).alias("id"))


def stats(graph: DataFrame) -> DataFrame:
    """Nodes, edges, least, greatest and average degree."""
    degree = F.size("local") + F.size("remote")
    return graph.agg(F.count("*").alias("nodes"), F.sum(degree).alias("edges"), F.min(degree).alias("min_degree"), F.max(degree).alias("max_degree"), F.avg(degree).alias("avg_degree"))


def bidirectional(edges: DataFrame) -> DataFrame:
    """edges(node, id) whose reverse is there too."""
    return edges.select("node", "id").intersect(edges.select(F.col("id").alias("node"), F.col("node").alias("id")))


def centroid_entry(base: DataFrame) -> DataFrame:
    """(id) of the row nearest to the mean of all; the lowest among equals."""
    axes = base.select(F.posexplode("vec").alias("axis", "x")).groupBy("axis").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("mean"))
    return base.crossJoin(F.broadcast(mean)).agg(F.min_by("id", F.struct(squared_l2("vec", "mean"), "id")).alias("id"))


def medoid_entry(base: DataFrame) -> DataFrame:
    """(id) of the row with the least sum of squared distances to all rows; the lowest among equals.

    The sum over all rows y of |x - y|^2 is n |x|^2 - 2 x (sum of y) + (sum of |y|^2), so no pairs are formed.
    """
    axes = base.select(F.posexplode("vec").alias("axis", "x")).groupBy("axis").agg(F.sum(F.col("x").cast("double")).alias("s"))
    whole = axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "s"))), lambda s: s["s"]).alias("sums"))
    squares = base.agg(F.count("*").alias("n"), F.sum(dot("vec", "vec")).alias("squares"))
    total = F.col("n") * dot("vec", "vec") - 2 * dot("vec", "sums") + F.col("squares")
    sums = base.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(squares)).select("id", F.round(total, 6).alias("total"))  # one row each
    return sums.agg(F.min_by("id", F.struct("total", "id")).alias("id"))


def violations(graph: DataFrame, nodes: int, degree: int, max_extra: int) -> DataFrame:
    """G10 and the invariants: (node, problem) of rows that break them."""
    every = F.concat("local", "remote", "extra")
    problem = (
        F.when((F.col("node") < 0) | (F.col("node") >= nodes) | F.exists(every, lambda i: (i < 0) | (i >= nodes)), "id out of range")
        .when(F.size("local") + F.size("remote") > degree, "degree exceeded")
        .when(F.size("extra") > max_extra, "extras exceeded")
        .when(F.array_contains(every, F.col("node")), "self-edge")
        .when(F.size(F.array_distinct(every)) < F.size(every), "duplicate edge")
    )
    repeated = graph.groupBy("node").count().where("count > 1").select("node", F.lit("repeated node").alias("problem"))
    return graph.select("node", problem.alias("problem")).where("problem is not null").union(repeated)
