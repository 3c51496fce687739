"""Command line: build or open an index over a vector file, calibrate on the first queries, search, evaluate.

    python -m vectide --base b.fvecs --query q.fvecs --k 10 --search-list-size 64,128 --output results --groundtruth gt.ivecs
    python -m vectide --base b.fvecs --query q.fvecs --labels labels.parquet --label-any color:red --label-none state:old

With several list sizes each is searched and summed up in turn; results are written for the last.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import functions as F

from vectide.errors import require
from vectide.index import CascadeConfig, GraphConfig, Index
from vectide.operators import calibration as C, evaluation as E
from vectide.operators.labels import MAX_CANDIDATES, LabelFilter, LabelKey, LabelStore
from vectide.session import session
from vectide.sources.sinks import write_results
from vectide.sources.vecfiles import ground_truth, read_vectors


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vectide", description=__doc__.splitlines()[0])
    p.add_argument("--base"), p.add_argument("--snapshot", help="open this index instead of building one")
    p.add_argument("--query", required=True), p.add_argument("--groundtruth"), p.add_argument("--output"), p.add_argument("--save")
    p.add_argument("--base-format"), p.add_argument("--query-format"), p.add_argument("--storage", choices=["f32", "u8"])
    p.add_argument("--metric", default="squared-l2"), p.add_argument("--k", type=int, default=10), p.add_argument("--search-list-size", type=list_sizes, default=[64])
    p.add_argument("--degree", type=int, default=64), p.add_argument("--build-l", type=int, default=100), p.add_argument("--alpha", type=float, default=1.2), p.add_argument("--max-extra", type=int, default=16)
    p.add_argument("--prefilter"), p.add_argument("--admission"), p.add_argument("--rerank"), p.add_argument("--window-size", type=int, default=5)
    p.add_argument("--max-points", type=int), p.add_argument("--calibration-queries", type=int, default=200), p.add_argument("--exact", action="store_true")
    p.add_argument("--preflight", action="store_true", help="print payload sizes and stop"), p.add_argument("--memory-budget-gib", type=float), p.add_argument("--cache-dir", help="keep built graphs here and reuse them"), p.add_argument("--master", default="local[*]")
    p.add_argument("--labels", help="Parquet of (namespace, value, id); the search is then exact, over the rows that pass the filter")
    for part in ("all", "any", "none"):
        p.add_argument(f"--label-{part}", action="append", default=[], metavar="NAMESPACE:VALUE")
    p.add_argument("--max-candidates", type=int, default=MAX_CANDIDATES)
    return p


def list_sizes(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def label_filter(a: argparse.Namespace) -> LabelFilter | None:
    """The filter of the options, or None if there is none."""
    keys = lambda texts: tuple(LabelKey(*t.split(":", 1)) if ":" in t else LabelKey("", t) for t in texts)
    out = LabelFilter(keys(a.label_all), keys(a.label_any), keys(a.label_none))
    require(out == LabelFilter() or a.labels or a.snapshot, "cli", "a label filter needs --labels or --snapshot")
    return out if out != LabelFilter() else None


def main(argv: list[str] | None = None) -> dict:
    a = arguments().parse_args(argv)
    if a.preflight:
        from vectide.sources.vecfiles import format_of, layout

        rows, dim, _, _ = layout(a.base, format_of(a.base, a.base_format))
        out = E.preflight(min(rows, a.max_points or rows), dim, a.degree, a.max_extra, 1 if a.storage == "u8" else 4, k=a.k, budget_gib=a.memory_budget_gib)
        print(json.dumps(out))
        return out
    require(bool(a.base) != bool(a.snapshot), "cli", "give either --base or --snapshot")
    require(not a.output or not os.path.exists(a.output), "cli", "output exists", "ALREADY_EXISTS", path=a.output)
    spark = session(a.master)
    if a.snapshot:
        index = Index.open(spark, a.snapshot)
    else:
        index = Index.from_file(spark, a.base, base_format=a.base_format, max_points=a.max_points, storage=a.storage, metric=a.metric, graph=GraphConfig(a.degree, a.build_l, a.alpha, a.max_extra), cascade=CascadeConfig(a.prefilter, a.admission, a.rerank), window_size=a.window_size, cache_dir=a.cache_dir, memory_budget_gib=a.memory_budget_gib)
    queries = read_vectors(spark, a.query, a.query_format).select(F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    wanted = label_filter(a)
    if a.labels:
        index.store = LabelStore(spark, index.rows, spark.read.parquet(a.labels).select("namespace", "value", F.col("id").cast("long").alias("id")))
    if not a.exact and not wanted and index.calibration(a.k) is None:
        index.calibrate(C.first_queries(queries, a.calibration_queries), k=a.k)
    n, runs, found = queries.count(), [], None
    truth = ground_truth(read_vectors(spark, a.groundtruth, "ivecs"), a.k, index.rows) if a.groundtruth else None
    for size in [None] if a.exact or wanted else a.search_list_size:
        if found is not None:
            found.unpersist()
        began = time.time()
        if wanted:
            found = index.search_filtered_table(queries, wanted, k=a.k, max_candidates=a.max_candidates)[0].cache()
        else:
            found = (index.search_exact(queries, k=a.k) if a.exact else index.search_table(queries, k=a.k, search_list_size=size)).cache()
        found.count()
        seconds = time.time() - began
        run = {"queries": n, "seconds": round(seconds, 3), "qps": round(n / seconds, 1)}
        if truth is not None:
            run["recall"] = E.mean_recall(E.recall(found, truth, a.k, divide_by_k=True)).first()[0]
        runs.append(run | ({"search_list_size": size} if size and len(a.search_list_size) > 1 else {}))
    if a.output:
        write_results(found, a.output)
    out = runs[-1] | ({"runs": runs} if len(runs) > 1 else {})
    if a.save:
        out["snapshot"] = json.loads(index.save(a.save).to_json())
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
