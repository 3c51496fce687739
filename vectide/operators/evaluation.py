"""Evaluation and diagnostics (E1-E18), as DataFrame expressions over result tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from vectide.errors import require


PERCENTILES = (0.5, 0.95, 0.99)


def recall(found: DataFrame, truth: DataFrame, k: int, divide_by_k: bool = False) -> DataFrame:
    """(query_id, recall) of found(query_id, rank, id) by truth: shared ids of the first k over min(k, truth), or k."""
    t = truth.where(F.col("rank") <= k).select("query_id", "id")
    hits = found.where(F.col("rank") <= k).select("query_id", "id").join(t, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    most = t.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("most"))
    over = F.lit(k) if divide_by_k else F.col("most")
    return most.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / over).alias("recall"))


def distinct_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Both sides deduplicated; queries with fewer than k true ids are left out."""
    t = truth.where(F.col("rank") <= k).select("query_id", "id").distinct()
    f = found.where(F.col("rank") <= k).select("query_id", "id").distinct()
    enough = t.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    hits = f.join(t, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    return enough.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


def mean_recall(per_query: DataFrame) -> DataFrame:
    """0 for no queries."""
    return per_query.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"))


def run_summary(per_query: DataFrame, seconds: float) -> DataFrame:
    """S9."""
    return per_query.agg(F.count("*").alias("queries"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall")).withColumn("qps", F.col("queries") / F.lit(seconds))


def sweep_medians(runs: DataFrame, target: float) -> tuple[DataFrame, DataFrame]:
    """E5: medians of runs(point, recall, qps) per point, and the fastest point at or above the target."""
    points = runs.groupBy("point").agg(F.percentile("recall", 0.5).alias("recall"), F.percentile("qps", 0.5).alias("qps"))
    best = points.where(F.col("recall") >= target).agg(F.max_by("point", F.struct("qps", "recall")).alias("point"), F.max("qps").alias("qps"))
    return points, best


def frontier(points: DataFrame) -> DataFrame:
    """points(recall, qps) that no point of higher recall beats in qps; the fastest at each recall."""
    best = points.groupBy("recall").agg(F.max("qps").alias("qps"))
    later = Window.orderBy(F.desc("recall")).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("above", F.max("qps").over(later)).where("above is null or qps > above").select("recall", "qps")


def qps_at(points: DataFrame, target: float) -> DataFrame:
    """(qps) at the target recall, interpolated between neighbours on the frontier; null outside it."""
    by = Window.orderBy("recall")
    f = frontier(points).withColumn("r1", F.lead("recall").over(by)).withColumn("q1", F.lead("qps").over(by))
    value = F.when(F.col("recall") == target, F.col("qps")).when((F.col("recall") < target) & (target < F.col("r1")), F.col("qps") + (F.col("q1") - F.col("qps")) * (F.lit(target) - F.col("recall")) / (F.col("r1") - F.col("recall")))
    return f.agg(F.max(value).alias("qps"))


def latency_summary(latencies: DataFrame, buckets: int = 4096) -> DataFrame:
    """Microseconds of latencies(ns); an entry above one hour is an error. Percentiles are exact, between neighbours linear.

    A histogram of at most `buckets` counts tells in which buckets the percentiles' ranks lie; only the distinct values of
    these are counted one by one, so no task holds all values.
    """
    spark = latencies.sparkSession
    whole = latencies.agg(F.count("ns").alias("n"), F.max("ns").alias("top"), (F.avg("ns") / 1000).alias("mean"), F.count_if(F.col("ns") == 0).alias("zeros")).first()
    require(whole["top"] is None or whole["top"] <= 3_600_000_000_000, "latency", "request exceeds the one-hour range", ns=whole["top"])
    n, at = whole["n"], {}
    if n:
        bucket = F.floor(F.col("ns") / (whole["top"] // buckets + 1)).cast("long")
        before, start = {}, 0
        for r in latencies.where("ns is not null").groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect():
            before[r["b"]] = (start, start + r["n"])
            start += r["n"]
        ranks = {f(p * (n - 1)) for p in PERCENTILES for f in (math.floor, math.ceil)}
        wanted = {r: next(b for b, (x, y) in before.items() if x <= r < y) for r in ranks}
        counted = latencies.withColumn("b", bucket).where(F.col("b").isin(sorted(set(wanted.values())))).groupBy("b", "ns").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("b").orderBy("ns"))
        starts = F.create_map(*[F.lit(x) for b in sorted(set(wanted.values())) for x in (b, before[b][0])])
        first = F.element_at(starts, F.col("b")) + upto - F.col("n")
        placed = counted.select("ns", first.alias("first"), (first + F.col("n")).alias("end"))
        hit = [F.max(F.when((F.col("first") <= r) & (F.col("end") > r), F.col("ns"))).alias(str(r)) for r in sorted(ranks)]
        got = placed.agg(*hit).first()
        at = {r: got[str(r)] for r in ranks}
    value = lambda p: (at[math.floor(p * (n - 1))] + (at[math.ceil(p * (n - 1))] - at[math.floor(p * (n - 1))]) * (p * (n - 1) % 1)) / 1000 if n else None
    names = ", ".join(f"p{round(p * 100)}_us double" for p in PERCENTILES)
    top = whole["top"] / 1000 if n else None
    return spark.createDataFrame([(n, whole["mean"], *map(value, PERCENTILES), top, whole["zeros"])], f"samples long, mean_us double, {names}, max_us double, zeros long")


def counters(results: DataFrame) -> DataFrame:
    """Totals of the walk's counters, one row a query counted once."""
    names = ["pre_hops", "post_hops", "pre_admits", "post_admits", "visits", "raw_visits", "sketch_evaluations", "expansions"]
    return results.where("rank = 1").agg(F.count("*").alias("queries"), *[F.sum(n).alias(n) for n in names])


def trace_page(trace: DataFrame, query_id: int, first: int, size: int) -> DataFrame:
    """Events [first, first + size) of a query's trace."""
    require(1 <= size <= 1024 and first >= 0, "trace", "page size must be in 1..1024", size=size)
    return trace.where((F.col("query_id") == query_id) & F.col("seq").between(first, first + size - 1)).orderBy("seq")


def trace_problems(trace: DataFrame) -> DataFrame:
    """(query_id, problem) of traces that are not one entry and then consecutive events of known types."""
    one = trace.groupBy("query_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.countDistinct("seq").alias("d"), F.min_by("type", "seq").alias("first"), F.max((~F.col("type").isin("entry", "expansion", "prefilter", "admission", "beam", "early_exit")).cast("int")).alias("odd"))
    problem = F.when((F.col("last") + 1 != F.col("n")) | (F.col("d") != F.col("n")), "gaps").when(F.col("first") != "entry", "no entry").when(F.col("odd") == 1, "unknown type")
    return one.select("query_id", problem.alias("problem")).where("problem is not null")


def cliffs(neighbours: DataFrame) -> DataFrame:
    """(node, cliff_rank, ratio, span) of neighbours(node, rank, dist): the greatest ratio of consecutive distances."""
    by = Window.partitionBy("node").orderBy("rank")
    step = neighbours.withColumn("ratio", F.try_divide(F.lead("dist").over(by), F.col("dist")))
    return step.groupBy("node").agg(F.max_by("rank", F.struct("ratio", -F.col("rank"))).alias("cliff_rank"), F.max("ratio").alias("ratio"), (F.max("dist") - F.min("dist")).alias("span"))


def rank_precision(edges: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """(k, precision): the mean over nodes of |first k + 1 edges and true top k + 1| / (k + 1), k from 0.

    An edge and a true neighbour meet once both ranks are within k + 1, so the greater of the two ranks is counted.
    """
    both = edges.select("node", "id", F.col("rank").alias("a")).join(truth.select("node", "id", F.col("rank").alias("b")), ["node", "id"])
    met = both.select(F.greatest("a", "b").alias("at")).where(F.col("at") <= most).groupBy("at").agg(F.count("*").alias("n"))
    nodes = F.broadcast(edges.agg(F.countDistinct("node").alias("nodes")))  # one row
    every = F.broadcast(edges.sparkSession.range(1, most + 1).withColumnRenamed("id", "at"))  # `most` rows
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("at"))
    return every.join(met, "at", "left").crossJoin(nodes).select((F.col("at") - 1).alias("k"), (total / F.col("nodes") / F.col("at")).alias("precision"))


def position_contribution(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, admitted): how many admitted ids stood at which position of the expanded node's edges(node, position, id)."""
    by = Window.partitionBy("query_id").orderBy("seq")
    node = F.last(F.when(F.col("type") == "expansion", F.col("node")), ignorenulls=True).over(by)
    came = trace.withColumn("from", node).where("type = 'admission'").select(F.col("from").alias("node"), F.explode("ids").alias("id"))
    return came.join(edges, ["node", "id"]).groupBy("position").agg(F.count("*").alias("admitted"))


def converged_steps(hops: DataFrame, window: int, limit: float) -> DataFrame:
    """A7 over a table: hops(query_id, step, admitted) with `converged`; a step looks at the admissions of those before it."""
    by = Window.partitionBy("query_id").orderBy("step")
    before = F.coalesce(F.lag("admitted").over(by), F.lit(1))
    fed = hops.withColumn("fed", (before > 0).cast("int"))
    rate = F.sum("fed").over(by.rowsBetween(1 - window, 0)) / F.lit(window)
    ready = (F.row_number().over(by) >= 2 * window) & (rate < limit)
    return fed.select("query_id", "step", "admitted", ready.alias("converged"))


def early_exits(hops: DataFrame, limit: int) -> DataFrame:
    """A8 over a table: (query_id, exit_step) of hops(query_id, step, admitted, converged): gaps and islands."""
    by = Window.partitionBy("query_id").orderBy("step")
    idle = F.col("converged") & (F.col("admitted") == 0)
    island = F.sum((~idle).cast("int")).over(by)
    runs = hops.withColumn("idle", idle).withColumn("island", island).where("idle")
    run = F.row_number().over(Window.partitionBy("query_id", "island").orderBy("step"))
    return runs.withColumn("run", run).where(F.col("run") >= limit).groupBy("query_id").agg(F.min("step").alias("exit_step"))


def preflight(rows: int, dim: int, degree: int = 64, max_extra: int = 16, element_bytes: int = 4, sidecar_bytes: int = 0, queries: int = 0, k: int = 10, budget_gib: float | None = None) -> dict:
    """Payload sizes by arithmetic; nothing is loaded. Allocator and runtime overhead are not included."""
    require(0 < rows < (1 << 32) - 1 and dim > 0, "preflight", "rows or dim out of range")
    require(budget_gib is None or (math.isfinite(budget_gib) and budget_gib > 0), "preflight", "budget must be finite and positive")
    parts = {"base": rows * dim * element_bytes, "graph": rows * 4 * (degree + max_extra + 4), "sidecars": rows * sidecar_bytes, "queries": queries * dim * 8, "results": queries * k * 4}
    total = sum(parts.values())
    return parts | {"total": total, "exceeds_budget": budget_gib is not None and total > budget_gib * (1 << 30)}


def matched_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, shared_steps): how many expansions two traces have in common before they part."""
    steps = lambda t, n: t.where("type = 'expansion'").select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("seq")).alias("step"), F.col("node").alias(n))
    both = steps(a, "x").join(steps(b, "y"), ["query_id", "step"], "left")
    parted = F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("step")))
    return both.groupBy("query_id").agg((F.coalesce(parted, F.max("step") + 1) - 1).alias("shared_steps"))


def phase_work(trace: DataFrame) -> DataFrame:
    """(phase, expansions, looked_at, admitted): how a trace's work is split over the phases of the walk."""
    of = lambda kind: F.sum(F.when(F.col("type") == kind, F.size("ids")).otherwise(0)).cast("long")
    return trace.groupBy("phase").agg(F.count_if(F.col("type") == "expansion").alias("expansions"), of("expansion").alias("looked_at"), of("admission").alias("admitted"))


def ablations(controls) -> dict:
    """The settings that are compared, by name: plain search, and adaptive search by what it looks at once converged."""
    from dataclasses import replace

    modes = {m: replace(controls, adaptive=True, mode=m) for m in ("full", "local-extra", "local")}
    return {"plain": replace(controls, adaptive=False), **modes, "prefix": replace(controls, adaptive=True, mode="local", prefix=8)}


def profile(search, settings: dict, truth: DataFrame, k: int) -> list[dict]:
    """For each named setting the recall, the counters and the seconds of search(setting)."""
    import time

    out = []
    for name, setting in settings.items():
        began = time.monotonic()
        found = search(setting).cache()
        n = counters(found).first().asDict()
        out.append({"name": name, "seconds": time.monotonic() - began, "recall": mean_recall(recall(found, truth, k)).first()[0], **n})
        found.unpersist()
    return out


def grid(search, settings: list[dict]) -> list[tuple[dict, DataFrame]]:
    """Results of search(**setting) for each setting of an ablation."""
    return [(s, search(**s)) for s in settings]
