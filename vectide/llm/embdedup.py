"""Near-duplicate vectors by sorted projection passes.

A pass draws random hyperplanes, writes the sides a vector lies on as the bits of one key and orders the vectors by it;
vectors that are close share a long prefix and end up near each other. Runs of the order are compared within a bounded
window, every pair in double precision, and the pairs at or above the threshold are united across passes. The number of
passes follows from the number of vectors and from how dense they lie: a sample tells how many bits the fullest
neighbourhood needs to come down to a window, and a pair exactly at the threshold must agree in as many. Planes through the
origin hardly part the vectors of a narrow cone, so these need more bits and more passes than vectors of all directions.

The passes find the components. The number of links of a vector is then counted by an exact check inside its component,
in blocks of bounded size that emit counts, never pairs. Exact copies are one class from the start, with a count.

Edge cases: a vector that is null, empty or zero, or holds a null, NaN or infinite component, links with nothing (no
links, its own component); vectors of different length never link; repeated rows are copies and link; null vec_ids are
kept and ignored when the smallest id is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.llm.components import connected_components
from vectide.llm.scratch import Scratch, arrow_rows, prepare, spread, table

THRESHOLD, RECALL, WINDOW, SEED = 0.9, 0.995, 512, 42
#: Rows that a task emits over all passes.
PER_TASK = 2_000_000
#: Bits of a pass's key that come from hyperplanes; the 16 below them break ties, so equal signatures can be split.
BITS = 46
#: Vectors of a run, and of a block of the exact check; at most so many runs, keys sampled per run to find their ends, and
#: at most so many keys sampled in all.
MOST_KEYS = 4_000_000
RUN, BLOCK, MOST_RUNS, SAMPLED = 4096, 256, 1 << 14, 64
#: Vectors whose neighbourhoods are measured, and those that they are measured by.
CENTRES, AROUND = 1024, 8192


def passes_needed(n: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW, bits: float = 1.0) -> int:
    """Passes after which a pair exactly at the threshold has met in a window with probability `recall`.

    `bits` are those that the fullest neighbourhood needs; log2(n / window) where the planes halve the vectors.
    """
    same_side = 1 - math.acos(threshold) / math.pi
    prefix = max(bits, 1.0, math.log2(max(n, 2) / window))
    meets = (1 - window / (2 * RUN)) * same_side**prefix
    return max(3, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def bits_needed(sample: np.ndarray, n: int, window: int) -> int:
    """Bits that leave at most a window of rows with the same ones, around any of the first CENTRES of the sampled unit vectors.

    Of n vectors, those at an angle t agree with the centre in b bits with probability (1 - t / pi) ** b. Vectors linked
    with the centre don't count: they belong to its component anyway.
    """
    cosines = np.clip(sample[:CENTRES] @ sample.T, -1.0, 1.0)
    same_side = np.where(cosines >= THRESHOLD, 0.0, 1 - np.arccos(cosines) / math.pi)
    left = same_side.copy()
    for b in range(1, BITS):
        if left.sum(axis=1).max(initial=0.0) * n / max(len(sample), 1) <= window:
            return b
        left *= same_side
    return BITS


def planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, dim]).standard_normal((BITS, dim))


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _key_batches(first: int, last: int):
    weights = (1 << np.arange(BITS, dtype=np.int64))[::-1]

    def keys(frames):
        for f in frames:
            for dim, part in f.groupby("dim"):
                x = unit(part["vec"])
                tie = (part["cid"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
                for p in range(first, last):
                    sides = (x @ planes(int(dim), p).T >= 0).astype(np.int64)
                    yield pd.DataFrame({"pass": p, "key": (sides @ weights << 16) | tie.astype(np.int64), "cid": part["cid"].to_numpy(), "dim": int(dim), "vec": part["vec"].to_numpy()})

    return keys


def _forest(near: np.ndarray, ids: np.ndarray):
    """Links that tie the rows of a window's boolean matrix (rows x rows and those that follow) into its components."""
    rows, both = near.shape
    left = near.any(axis=1)
    while left.any():
        at = int(left.argmax())
        seen = np.zeros(both, bool)
        front = np.zeros(rows, bool)
        front[at] = True
        while front.any():
            left &= ~front
            reached = near[front].any(axis=0)
            seen[:rows] |= front
            back = near[:, reached].any(axis=1) if reached.any() else np.zeros(rows, bool)
            seen |= reached
            front = (reached[:rows] | back) & left
        members = ids[seen]
        root = members.min()
        yield from ((int(m), int(root)) for m in members if m != root)


def _compare_run(f: pd.DataFrame) -> pd.DataFrame:
    """Links within a window along one run of the order."""
    found: set[tuple[int, int]] = set()
    for _, part in f.groupby("dim"):
        part = part.sort_values(["key", "cid"])
        x, ids = unit(part["vec"]), part["cid"].to_numpy()
        for a in range(0, len(x), WINDOW):
            near = x[a : a + WINDOW] @ x[a : a + 2 * WINDOW].T >= THRESHOLD
            near[np.arange(len(near)), np.arange(len(near))] = False
            found.update(_forest(near, ids[a : a + 2 * WINDOW]))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _count_block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    """Links of the vectors of chunk i of a component with those of chunk j, weighted by the number of copies."""
    _, i, j = key
    out = []
    for _, part in f.groupby("dim"):
        chunk = part["chunk"].to_numpy()
        x, n, ids = unit(part["vec"]), part["n"].to_numpy(), part["cid"].to_numpy()
        a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        if len(a) and len(b):
            near = x[a] @ x[b].T >= THRESHOLD
            if i == j:
                np.fill_diagonal(near, False)
            else:
                out.append((ids[b], near.T @ n[a]))
            out.append((ids[a], near @ n[b]))
    if not out:
        return pd.DataFrame({"cid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
    return pd.DataFrame({"cid": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]).astype(np.int64)})


def link_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of rows(vec_id, embedding)."""
    prepare(rows.sparkSession)
    with arrow_rows(rows.sparkSession, 4096):  # all that runs in Python is written within
        return _link(rows)


def _link(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark, "embdedup")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    vec = F.col("vec")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    classes = rows.where(good).groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("vec").alias("dim"), "vec", "n", "low"), "classes")

    total = classes.count()
    around = classes.where(F.pmod(F.xxhash64("cid", F.lit(SEED)), F.lit(1_000_003)) < min(1.0, AROUND / max(total, 1)) * 1_000_003).select("dim", "vec").toPandas()
    bits = max((bits_needed(unit(part["vec"]), total * len(part) // len(around), WINDOW) for _, part in around.groupby("dim")), default=1)
    number = passes_needed(total, window=WINDOW, bits=bits)
    runs = min(MOST_RUNS, -(-total // RUN))
    edges = None
    dealt = spread(classes.select("cid", "dim", "vec"), "cid", total, max(1, PER_TASK // number))
    keyed = dealt.mapInPandas(_key_batches(0, number), f"pass int, key long, cid long, dim int, vec {dict(classes.dtypes)['vec']}")
    if runs > 1:
        share = min(1.0, min(SAMPLED * runs, MOST_KEYS // number) / total)
        sample = classes.select("cid", "dim", "vec").where(F.abs(F.xxhash64("cid")) % 1_000_003 < share * 1_000_003)
        found = sample.mapInPandas(_key_batches(0, number), keyed.schema).select("pass", "key").toPandas()
        ends = {int(p): np.quantile(k["key"].to_numpy(), np.arange(1, runs) / runs, method="nearest").tolist() for p, k in found.groupby("pass")}
        cuts = F.create_map(*[x for p in range(number) for x in (F.lit(p), F.array(*[F.lit(int(e)) for e in ends.get(p, [])]).cast("array<bigint>"))]) if number * runs <= 4096 else None
        run = F.size(F.filter(F.element_at(cuts, F.col("pass")), lambda e: e <= F.col("key"))) if cuts is not None else _run_of(spark, ends)("pass", "key")
        keyed = keyed.withColumn("run", run)
    else:
        keyed = keyed.withColumn("run", F.lit(0))
    edges = keyed.groupBy("pass", "run").applyInPandas(_compare_run, "a long, b long")
    roots = scratch.keep(connected_components(edges.distinct(), scratch), "roots")

    sized = scratch.keep(roots.groupBy("root").agg(F.count("*").alias("size")), "sized")
    inside = roots.join(sized, "root").select(F.col("node").alias("cid"), "root", F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks"))
    member = classes.join(scratch.keep(inside, "inside"), "cid").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    blocks = member.withColumn("other", other).select("cid", "dim", "vec", "n", "chunk", "root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    counts = blocks.groupBy("root", "i", "j").applyInPandas(_count_block, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    least = scratch.keep(classes.select("cid", "low").join(roots, F.col("cid") == F.col("node")).groupBy("root").agg(F.min("low").alias("least")), "least")
    where = scratch.keep(roots.join(least, "root").select(F.col("node").alias("cid"), "least"), "where")
    counts = scratch.keep(counts, "counts")
    known = classes.join(where, "cid", "left").join(counts, "cid", "left")
    known = scratch.keep(known.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "known")
    linked = rows.where(good).join(known, "vec").select("vec_id", "n_links", "component_id")
    return linked.union(rows.where(~good).select("vec_id", F.lit(0).cast("long"), "vec_id"))


def _run_of(spark, ends):
    """The number of the run by binary search, for cuts too many for an expression (bounded by MOST_RUNS a pass)."""
    shared = spark.sparkContext.broadcast({p: np.array(e, np.int64) for p, e in ends.items()})

    @F.pandas_udf("int")
    def run(p: pd.Series, key: pd.Series) -> pd.Series:
        out = pd.Series(0, index=p.index, dtype="int32")
        for q in p.unique():
            at = p == q
            out[at] = np.searchsorted(shared.value.get(int(q), np.zeros(0)), key[at].to_numpy(), side="right").astype(np.int32)
        return out

    return run


def op5_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine >= 0.9, its component and whether it stays."""
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: All pairs, and what is reachable over the links, in DuckDB.
OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
good AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS norm FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= {THRESHOLD}),
reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN counts ON a = vec_id
"""
