"""Graph search (A1-A20): an adaptive beam over a proximity graph, with prefilter, admission and rerank stages.

The beam is sequential per query, so it runs in NumPy; queries are spread over tasks and the graph with its codes is
shared. Where that would exceed SHARED_BYTES the base is sharded instead: each shard is searched in its own task and the
shards' best are merged (see `search_shards`).

What is observable is kept as specified: the beam orders by (distance, id); neighbours are admitted if nearer than the
beam's worst as of the last flush; convergence looks at the previous expansion's admissions; the prefilter's cutoff is
the mean of the means of the beam's sketch distances, times SLACK.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vectide.errors import require
from vectide.functions.vectors import COSINE, IP, L2, metric_of
from vectide.operators.graph import pair_distances
from vectide.session import share_code

# Names of the stages' arms.
ADMISSION = ("l2-u8", "l2-u16", "l2-kt", "ip-i8", "ip-i16", "cosine-i8", "cosine-i16", "pq-l2", "pq-ip", "pq-cosine", "native-l2-u8", "native-ip-u8", "native-cosine-u8", "ads-f32", "exact-f32")
PREFILTER = ("none", "jl", "jl-hadamard", "rabitq")
RERANK_ARMS = ("none", "l2-f32", "ip-f32", "cosine-f32", "l2-u16")

# Slack of sampled distances and axes between their checks.
ADS_SLACK, ADS_STEP = 2.1, 64

# Hops before the main loop, flush intervals before and after convergence, prefilter slack, rerank factor.
PEEL, FLUSH, SLACK, RERANK = 3, (1, 4), 1.05, 2
SHARED_BYTES = 1 << 30


@dataclass(frozen=True)
class CascadeConfig:
    prefilter: str | None = None
    admission: str | None = None
    rerank: str | None = None


def default_cascade(metric: str, dim: int, u8: bool = False) -> CascadeConfig:
    """A13."""
    metric = metric_of(metric)
    if u8:
        return CascadeConfig("none", {L2: "native-l2-u8", IP: "native-ip-u8", COSINE: "native-cosine-u8"}[metric], "none")
    if metric == L2:
        return CascadeConfig("jl", "l2-kt", "l2-f32") if dim >= 512 else CascadeConfig("none", "l2-u8", "l2-f32")
    return CascadeConfig("none", "ip-i8", "ip-f32") if metric == IP else CascadeConfig("none", "cosine-i8", "cosine-f32")


def resolve_cascade(config: CascadeConfig, metric: str, dim: int, u8: bool = False) -> CascadeConfig:
    """Defaults filled in; stages that don't go with the metric or with each other are refused."""
    metric = metric_of(metric)
    d = default_cascade(metric, dim, u8)
    out = CascadeConfig(config.prefilter or d.prefilter, config.admission or d.admission, config.rerank or d.rerank)
    for name, value, known in (("prefilter", out.prefilter, PREFILTER), ("admission", out.admission, ADMISSION), ("rerank", out.rerank, RERANK_ARMS)):
        require(value in known, "cascade", f"unknown {name}", value=value)
    word = {L2: ("l2",), IP: ("ip",), COSINE: ("cosine",)}[metric]
    fits = lambda s: s in ("none", "exact-f32") or any(w in s.split("-") for w in word) or (s == "ads-f32" and metric == L2)
    require(fits(out.admission) and fits(out.rerank), "cascade", "stage and metric don't go together", metric=metric, admission=out.admission, rerank=out.rerank)
    require(not u8 or out.admission.startswith("native-") or out.admission == "exact-f32", "cascade", "native bytes need a native admission stage")
    require(metric == L2 or out.prefilter in ("none", "jl"), "cascade", "prefilter and metric don't go together", prefilter=out.prefilter)
    require(not (out.rerank == "l2-u16" and out.admission == "l2-u16"), "cascade", "rerank must be finer than admission")
    return out


def check_controls(k: int, beam: int, rows: int, window: int = 5) -> None:
    """A15."""
    require(1 <= k <= rows, "search", "k must be in 1..rows", k=k, rows=rows)
    require(k <= beam <= ((1 << 32) - 1) // 4, "search", "search_list_size must be at least k", search_list_size=beam)
    require(1 <= window <= 64, "search", "window_size must be in 1..64", window_size=window)


@dataclass
class Convergence:
    """Converged if fewer than `threshold` of the last `window` expansions admitted anything, from 2 windows on."""

    window: int
    threshold: float
    recent: deque = field(default_factory=deque)
    steps: int = 0

    def update(self, admitted: int) -> bool:
        self.steps += 1
        self.recent.append(admitted > 0)
        if len(self.recent) > self.window:
            self.recent.popleft()
        if len(self.recent) < self.window or self.steps < 2 * self.window:
            return False
        return bool(np.float32(sum(self.recent)) / np.float32(self.window) < np.float32(self.threshold))


@dataclass
class EarlyExit:
    """Stop after `limit` converged expansions in a row that admit nothing."""

    limit: int
    idle: int = 0

    def should_exit(self, converged: bool, admitted: int) -> bool:
        self.idle = self.idle + 1 if converged and not admitted else 0
        return converged and not admitted and self.idle >= self.limit


class Beam:
    """A2: the `width` nearest by (distance, id), each once, with those not expanded yet."""

    def __init__(self, width: int):
        self.width, self.items, self.visited = width, [], set()

    def insert(self, d: float, i: int) -> None:
        at = (d, i)
        if len(self.items) >= self.width and at >= self.items[-1]:
            return
        k = bisect.bisect_left(self.items, at)
        if k < len(self.items) and self.items[k] == at:
            return
        self.items.insert(k, at)
        del self.items[self.width :]

    def next(self) -> int | None:
        for d, i in self.items:
            if i not in self.visited:
                self.visited.add(i)
                return i
        return None

    def has_next(self) -> bool:
        return any(i not in self.visited for _, i in self.items)

    def worst(self) -> float:
        return self.items[-1][0] if len(self.items) >= self.width else float("inf")


@dataclass
class SharedGraph:
    """What every task needs: adjacency by row position, row ids, entry, and the stages' data."""

    ids: np.ndarray
    full: list[np.ndarray]
    local: list[np.ndarray]
    extra: list[np.ndarray]
    entry: int

    def bytes(self) -> int:
        return sum(a.nbytes for part in (self.full, self.local, self.extra) for a in part) + self.ids.nbytes


@dataclass(frozen=True)
class Controls:
    """threshold and early_exit_limit come from calibration; adaptive=False is plain greedy search (A17);
    mode: 'local-extra', 'local' or 'full' neighbours after convergence (E14); prefix: A19's first m neighbours."""

    k: int
    beam: int
    threshold: float = 0.15
    early_exit_limit: int = 3
    window: int = 5
    adaptive: bool = True
    mode: str = "local-extra"
    prefix: int | None = None


def walk(graph: SharedGraph, distance: Callable[[np.ndarray], np.ndarray], c: Controls, sketch: Callable[[np.ndarray], np.ndarray] | None = None, trace: list | None = None) -> tuple[Beam, dict]:
    """A1: the beam after the walk, and counters. distance and sketch give a query's distances to row positions.

    A distance that is a Sampled also gets the beam's worst distance, beyond which it may answer infinity.
    """
    note = (lambda kind, **x: trace.append({"type": kind, **x})) if trace is not None else (lambda kind, **x: None)
    beam, seen = Beam(c.beam), {graph.entry}
    beam.insert(float(distance(np.array([graph.entry]))[0]), graph.entry)
    scc, leave = Convergence(c.window, c.threshold if c.adaptive else -1.0), EarlyExit(c.early_exit_limit)
    n = {"pre_hops": 0, "post_hops": 0, "pre_admits": 0, "post_admits": 0, "visits": 0, "raw_visits": 0, "sketch_evaluations": 0, "expansions": 0}
    previous, pending, since, means, mean, last_worst = 1, [], 0, [], 0.0, None
    note("entry", node=int(graph.entry))

    def fresh(lists) -> np.ndarray:
        out = []
        for j in lists:
            if j not in seen:
                seen.add(j)
                out.append(j)
        return np.array(out, np.int64)

    hop = 0
    while True:
        peel = hop < PEEL
        node = beam.next()
        if node is None:
            break
        converged = False if peel else scc.update(previous)
        if not converged or c.mode == "full":
            found = fresh(graph.full[node].tolist())
        elif c.prefix is not None:
            found = fresh(graph.full[node][: c.prefix].tolist())
        else:
            found = fresh(graph.local[node].tolist() + (graph.extra[node].tolist() if c.mode == "local-extra" else []))
        worst, raw = beam.worst(), len(found)
        note("expansion", node=int(node), converged=bool(converged), peel=peel, ids=found.tolist())
        if not peel and sketch is not None and len(beam.items) >= c.beam:
            tail = beam.items[-1][1]
            if not means or tail != last_worst:
                held = np.array([i for _, i in beam.items])
                mean, last_worst = float(np.mean(sketch(held))), tail
                n["sketch_evaluations"] += len(held)
            means.append(mean)
            cutoff = sum(means) / len(means) * SLACK
            n["sketch_evaluations"] += raw
            found = found[sketch(found) < cutoff] if raw else found
            note("prefilter", cutoff=cutoff, rejected=raw - len(found))
        d = np.zeros(0) if not len(found) else distance(found, worst) if isinstance(distance, Sampled) else distance(found)
        ok = d < worst
        admitted = int(ok.sum())
        pending += zip(d[ok].tolist(), found[ok].tolist(), strict=True)
        note("admission", ids=found[ok].tolist(), distances=d[ok].tolist())
        phase = "post" if converged else "pre"
        n[f"{phase}_hops"] += 1
        n[f"{phase}_admits"] += admitted
        n["visits"] += len(found)
        n["raw_visits"] += raw
        n["expansions"] += 1
        if peel:
            scc.update(previous)
            leave.should_exit(False, previous)
            stop = False
        else:
            stop = c.adaptive and leave.should_exit(converged, admitted)
            since += 1
        if peel or since >= FLUSH[converged] or stop or not beam.has_next():
            for item in pending:
                beam.insert(*item)
            pending, since = [], 0
            note("beam", ids=[i for _, i in beam.items])
        previous = admitted
        hop += 1
        if stop:
            note("early_exit")
            break
    return beam, n


def shared_graph(base: DataFrame, graph: DataFrame, entry_id: int, most: int = SHARED_BYTES) -> tuple[SharedGraph, np.ndarray]:
    """The graph and the base as arrays, for broadcasting; refused beyond `most` bytes (search shards instead)."""
    size = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    edges = graph.agg(F.sum(F.size("local") * 2 + F.size("remote") + F.size("extra")).alias("e")).first()["e"] or 0
    # a row as floats and as codes (8 bytes a coordinate at most), three arrays a node with some 112 bytes each besides edges
    total = size["n"] * ((size["d"] or 0) * 12 + 3 * 112) + edges * 8
    require(total <= most, "search", "graph and rows exceed what is shared with every task; search by shards", "RESOURCE_EXHAUSTED", bytes=total, limit=most)
    rows = base.select(F.col("id").cast("long").alias("id"), "vec").orderBy("id").toPandas()
    ids = rows["id"].to_numpy()
    x = np.stack(rows["vec"].to_numpy()).astype(np.float32)
    at = {int(i): k for k, i in enumerate(ids)}
    g = graph.toPandas().set_index("node")
    get = lambda col: [np.array([at[int(j)] for j in g.at[i, col] if int(j) in at], np.int32) for i in ids.tolist()]
    local, remote, extra = get("local"), get("remote"), get("extra")
    return SharedGraph(ids, [np.concatenate(p) for p in zip(local, remote, strict=True)], local, extra, at[int(entry_id)]), x


@dataclass
class Sampled:
    """Squared distances over rotated axes; infinity once a check of the axes so far says that the bound is passed."""

    rows: np.ndarray
    query: np.ndarray

    def __call__(self, at: np.ndarray, bound: float = np.inf) -> np.ndarray:
        parts = np.cumsum((self.rows[at].astype(np.float64) - self.query) ** 2, axis=1)
        dim = parts.shape[1]
        out = parts[:, -1].copy()
        if np.isfinite(bound):
            for n in range(ADS_STEP, dim, ADS_STEP):
                out[parts[:, n - 1] * (dim / n) > bound * (1 + ADS_SLACK / np.sqrt(n))] = np.inf
            out[out >= bound] = np.inf
        return out


class Stages:
    """The distances of the cascade's stages against a base matrix, fitted once and shared."""

    def __init__(self, x: np.ndarray, metric: str, cascade: CascadeConfig):
        from vectide.operators import quantizers as Q

        self.metric, self.cascade, self.x = metric, cascade, x
        low, high = float(x.min()), float(x.max())
        a, dim = cascade.admission, x.shape[1]
        if a in ("l2-u8", "l2-u16", "l2-kt"):
            self.code = Q.AffineCode(low, high, 65535 if a == "l2-u16" else 255)
            self.codes = self.affine(x).astype(np.float64)
        elif a in ("ip-i8", "ip-i16", "cosine-i8", "cosine-i16"):
            self.code = Q.SymmetricCode(max(abs(low), abs(high)), 127 if a.endswith("i8") else 32767)
            self.codes = self.symmetric(x).astype(np.float64)
        elif a.startswith("pq-"):
            pick = np.sort(np.random.default_rng(42).choice(len(x), min(len(x), 4096), replace=False))
            self.pq = Q.ProductCode([Q.kmeans(p, 256, seed=42 + i) for i, p in enumerate(np.array_split(x[pick].astype(np.float64), min(-(-dim // 8), 64), axis=1))])
            self.codes = self.pq.codes(x.astype(np.float64))
        elif a == "ads-f32":
            self.spin = Q.rotation(dim)
            self.spun = (x @ self.spin.T).astype(np.float32)
        if cascade.rerank == "l2-u16":
            self.fine = Q.AffineCode(low, high, 65535)
            self.fine_codes = self.affine(x, self.fine)
        p = cascade.prefilter
        if p == "jl":
            self.jl = Q.SparseSketch(Q.sparse_indices(dim)).matrix(dim)
            self.bits = x @ self.jl.T > 0
        elif p == "jl-hadamard":
            self.jlh = Q.hadamard_bits(dim)
            self.bits = self.jlh(x.astype(np.float64))
        elif p == "rabitq":
            self.turn = Q.rotation(dim)
            self.turned = x @ self.turn.T
            self.active = Q.OneBitCode.prefilter_active(dim)
            self.signs, self.norms = np.where(self.turned >= 0, 1.0, -1.0), np.linalg.norm(x, axis=1)

    def affine(self, v, code=None):
        from vectide.operators.quantizers import half_away

        code = code or self.code
        return np.clip(half_away((v.astype(np.float32) * np.float32(code.slope)).astype(np.float64)) - code.offset, 0, code.top)

    def symmetric(self, v):
        from vectide.operators.quantizers import half_away

        return np.clip(half_away(v.astype(np.float32) * np.float32(self.code.scale)), -self.code.top, self.code.top)

    def admission(self, q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Distances to rows at some positions; `native-*` and `exact-f32` are exact. Only `ads-f32` makes use of a bound."""
        a, x = self.cascade.admission, self.x
        if a == "ads-f32":
            return Sampled(self.spun, self.spin @ q)
        if a in ("l2-u8", "l2-u16", "l2-kt"):
            c = self.affine(q).astype(np.float64)
            return lambda at: ((self.codes[at] - c) ** 2).sum(1)
        if a in ("ip-i8", "ip-i16", "cosine-i8", "cosine-i16"):
            c = self.symmetric(q).astype(np.float64)
            return lambda at: -(self.codes[at] @ c)
        if a.startswith("pq-"):
            table = self.pq.lookup(q.astype(np.float64), inner_product=self.metric != L2)
            return lambda at: self.pq.estimate(table, self.codes[at])
        wide = q.astype(np.float64)
        if self.metric == COSINE:
            return lambda at: 1 - (x[at] @ wide) / (np.linalg.norm(x[at].astype(np.float64), axis=1) * np.linalg.norm(wide))
        return lambda at: pair_distances(self.metric, wide[None], x[at].astype(np.float64))[0] if self.metric != L2 else ((x[at] - wide) ** 2).sum(1)

    def prefilter(self, q: np.ndarray) -> Callable[[np.ndarray], np.ndarray] | None:
        p = self.cascade.prefilter
        if p in ("jl", "jl-hadamard"):
            own = self.jl @ q > 0 if p == "jl" else self.jlh(q[None].astype(np.float64))[0]
            return lambda at: (self.bits[at] != own).sum(1).astype(np.float64)
        if p == "rabitq" and self.active:
            r = self.turn @ q
            r = np.where(r > 0, r, -np.abs(r))
            scale = np.sqrt(2 * len(q) / np.pi)
            return lambda at: np.maximum(0, q @ q + self.norms[at] ** 2 - 2 * (self.signs[at] @ r) * self.norms[at] / scale)
        return None

    def rerank(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The distances that the last stage orders by."""
        if self.cascade.rerank == "l2-u16":
            return ((self.fine_codes[at] - self.affine(q, self.fine)) ** 2).sum(1)
        return self.exact(q, at)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        wide, rows = q.astype(np.float64), self.x[at].astype(np.float64)
        if self.metric == L2:
            return ((rows - wide) ** 2).sum(1)
        s = rows @ wide
        if self.metric == COSINE:
            s = np.clip(s / (np.linalg.norm(rows, axis=1) * np.linalg.norm(wide)), -1, 1)
        return -s


def answer(graph: SharedGraph, stages: Stages, q: np.ndarray, c: Controls, trace: list | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Ids, scores and counters of one query: walk, then rerank (A9, A10) of the first min(2k, beam)."""
    unit = q / np.linalg.norm(q) if stages.metric == COSINE else q
    beam, n = walk(graph, stages.admission(unit), c, stages.prefilter(unit), trace)
    at = np.array([i for _, i in beam.items], np.int64)
    if stages.cascade.rerank == "none":
        at = at[: c.k]
    else:
        at = at[: min(RERANK * c.k, len(at))]
    if stages.cascade.rerank != "none":
        at = at[np.lexsort((graph.ids[at], stages.rerank(q, at).astype(np.float32)))[: c.k]]
    d = stages.exact(q, at)
    return graph.ids[at], d if stages.metric == L2 else -d, n


RESULT = "query_id long, rank int, id long, score double"
COUNTERS = "pre_hops long, post_hops long, pre_admits long, post_admits long, visits long, raw_visits long, sketch_evaluations long, expansions long"


def search(queries: DataFrame, graph: SharedGraph, stages: Stages, c: Controls) -> DataFrame:
    """Results (query_id, rank, id, score and the counters of the walk) of queries(query_id, vec), in parallel."""
    check_controls(c.k, c.beam, len(graph.ids), c.window)
    spark = share_code(queries.sparkSession)
    shared = spark.sparkContext.broadcast((graph, stages))

    def batches(frames):
        g, s = shared.value
        for f in frames:
            out = []
            for qid, v in zip(f["query_id"], f["vec"], strict=True):
                ids, scores, n = answer(g, s, np.asarray(v, np.float64), c)
                out.append(pd.DataFrame({"query_id": qid, "rank": np.arange(1, len(ids) + 1, dtype=np.int32), "id": ids, "score": scores, **n}))
            if out:
                yield pd.concat(out)

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec")
    return asked.repartition(max(1, spark.sparkContext.defaultParallelism), "query_id").mapInPandas(batches, f"{RESULT}, {COUNTERS}")


SHARD = "shard int, id long, vec array<float>, near array<int>, extra array<int>, entry boolean"


def shard_graphs(shards: DataFrame, config, metric: str) -> DataFrame:
    """SHARD rows of shards(id, vec, shard): each shard's graph, by positions in order of id. Keep it: building is what costs."""
    from vectide.operators.graph import build_shard

    metric = metric_of(metric)
    share_code(shards.sparkSession)

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        x = np.stack(f["vec"].to_numpy()).astype(np.float32)
        edges, captured, entry = build_shard(x.astype(np.float64), config, metric)
        return pd.DataFrame({"shard": f["shard"].to_numpy(), "id": f["id"].to_numpy(), "vec": list(x), "near": [np.array(e, np.int32) for e in edges], "extra": [np.array(sorted(e)[: config.max_extra], np.int32) for e in captured], "entry": np.arange(len(f)) == entry})

    return shards.select(F.col("id").cast("long").alias("id"), "vec", F.col("shard").cast("int").alias("shard")).groupBy("shard").applyInPandas(build, SHARD)


def opened_shard(f: pd.DataFrame, metric: str, cascade: CascadeConfig | None = None, local_pct: int = 60) -> tuple[SharedGraph, Stages]:
    """A shard's rows as what a walk needs."""
    f = f.sort_values("id")
    x, near = np.stack(f["vec"].to_numpy()).astype(np.float32), [np.asarray(e, np.int32) for e in f["near"]]
    g = SharedGraph(f["id"].to_numpy(), near, [e[: max(1, int(len(e) * local_pct / 100 + 0.5))] for e in near], [np.asarray(e, np.int32) for e in f["extra"]], int(np.argmax(f["entry"].to_numpy())))
    return g, Stages(x, metric, resolve_cascade(cascade or CascadeConfig(), metric, x.shape[1]))


def search_shards(graphs: DataFrame, queries: DataFrame, c: Controls, metric: str, cascade: CascadeConfig | None = None, local_pct: int = 60) -> DataFrame:
    """(query_id, rank, id, score) over shard_graphs: every query meets every shard on the executors, the best are merged.

    For bases whose graph can't be shared. The result differs from that of one graph: each shard has its own entry.
    """
    from vectide.functions.vectors import rank_key

    metric = metric_of(metric)
    share_code(graphs.sparkSession)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).crossJoin(graphs.select(F.col("shard").alias("to")).distinct())  # as often as there are shards

    def one(f: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(f):
            g, s = opened_shard(f, metric, cascade, local_pct)
            for qid, v in zip(q["query_id"], q["vec"], strict=True):
                ids, scores, _ = answer(g, s, np.asarray(v, np.float64), c)
                out.append(pd.DataFrame({"query_id": qid, "id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = graphs.groupBy("shard").cogroup(asked.groupBy("to")).applyInPandas(one, "query_id long, id long, score double").dropDuplicates(["query_id", "id"])
    by = Window.partitionBy("query_id").orderBy(rank_key(metric, F.col("score")), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= c.k).select("query_id", "rank", "id", "score")


def search_sharded(base: DataFrame, queries: DataFrame, c: Controls, metric: str, shards: DataFrame, config=None, cascade: CascadeConfig | None = None) -> DataFrame:
    """search_shards over graphs that are built for it from shards(id, vec, shard)."""
    from vectide.operators.graph import GraphConfig

    config = config or GraphConfig()
    return search_shards(shard_graphs(shards, config, metric), queries, c, metric, cascade, config.local_pct)


def trace_of(queries: DataFrame, graph: SharedGraph, stages: Stages, c: Controls) -> DataFrame:
    """One row per event: (query_id, seq, type, node, phase, ids, distances)."""
    spark = share_code(queries.sparkSession)
    shared = spark.sparkContext.broadcast((graph, stages))

    def batches(frames):
        g, s = shared.value
        for f in frames:
            rows = []
            for qid, v in zip(f["query_id"], f["vec"], strict=True):
                events: list = []
                answer(g, s, np.asarray(v, np.float64), c, events)
                phase = "peel"
                for seq, e in enumerate(events):
                    phase = ("peel" if e["peel"] else "converged" if e["converged"] else "exploring") if e["type"] == "expansion" else phase
                    ids = [int(g.ids[i]) for i in e.get("ids", [])]
                    rows.append((qid, seq, e["type"], int(g.ids[e["node"]]) if "node" in e else None, phase, ids, [float(x) for x in e.get("distances", [])]))
            yield pd.DataFrame(rows, columns=["query_id", "seq", "type", "node", "phase", "ids", "distances"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "vec").mapInPandas(batches, "query_id long, seq int, type string, node long, phase string, ids array<long>, distances array<double>")
