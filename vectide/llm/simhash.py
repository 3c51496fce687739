"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most two bits have a common neighbour within one bit of each. So every
distinct fingerprint emits itself and its 64 one-bit variants, the variants are shuffled, and the fingerprints that
meet on a variant are linked: the search is complete, with a fixed fan-out of 65 whatever the data. At most 65 distinct
fingerprints can meet on a variant, and each is tied to the smallest of them only, so no group is expanded into pairs.
Documents with the same fingerprint are one node from the start, however many they are.

Edge cases: null text counts as empty and has fingerprint zero, which links like any other; a document with fewer than
three words has one shingle, the whole sequence; null doc_ids are kept and count last when a group's smallest id is
taken (null only if all ids of the group are); repeated rows keep a row each (but `keep_one` keeps one); an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectide.llm.components import connected_components
from vectide.llm.scratch import Scratch, let_go, prepare, spread, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are unpacked at once (64 bytes each).
CHUNK = 1 << 18
#: Fingerprints whose variants a task emits.
PER_TASK = 250_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of `size` words; ASCII letters are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes; run i ends before ends[i]. A bit is set if over half of a run set it."""
    starts = np.concatenate(([0], ends[:-1]))
    counts = np.zeros((len(ends), 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.searchsorted(ends, at, side="right")
        last = np.searchsorted(starts, at + len(bits), side="left")
        rows = np.arange(first, last)[(np.minimum(ends[first:last], at + len(bits)) > np.maximum(starts[first:last], at))]
        counts[rows] += np.add.reduceat(bits, np.maximum(starts[rows] - at, 0), axis=0, dtype=np.int32)
    on = counts * 2 > (ends - starts)[:, None]
    return np.packbits(on, axis=1, bitorder="little").reshape(-1).view(np.uint64).view(np.int64)


def _fingerprint_batches(batches):
    let_go()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        fps, runs, total = [], [], 0

        def flush():
            if runs:
                flat = np.fromiter((h for r in runs for h in r), np.uint64, total)
                fps.append(majority(flat, np.cumsum([len(r) for r in runs])))

        for t in texts:
            runs.append(shingle_hashes(t or b""))
            total += len(runs[-1])
            if total > CHUNK:
                flush()
                runs, total = [], 0
        flush()
        yield pa.record_batch([batch.column("doc_id"), batch.column("of"), pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64), pa.int64())], ["doc_id", "of", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, of, fp) for each row of docs(doc_id, text), `of` being a hash of the text; map only."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), text.alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, of long, fp long")


def ball_links(points: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fp of points(fp) within RADIUS bits: each tied to the least on a variant."""
    points = spread(points, "fp", points.count(), PER_TASK)
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    balls = points.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    hub = F.min("fp").over(Window.partitionBy("variant"))
    met = balls.withColumn("hub", hub).where("fp <> hub")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def grouped(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, of, fp) of each row, and (fp, root, component_id) of each fingerprint: its group, and that one's smallest doc_id."""
    fps = scratch.keep(fingerprints(docs), "fps")
    points = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")
    roots = connected_components(ball_links(points.select("fp")), scratch)
    named = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = scratch.keep(named, "named")
    least = scratch.keep(named.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    return fps, scratch.keep(named.join(least, "root").select("fp", "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text): the smallest doc_id reachable over links."""
    fps, groups = grouped(docs, Scratch(docs.sparkSession, "simhash"))
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint in hex and the smallest doc_id of its near-duplicate group."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group one row stays, that with the smallest doc_id.

    Rows are told apart by doc_id and text: of a group's rows with the smallest id (null if all are) the text with the
    least hash stays, and of rows that repeat both, one.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    fps, groups = grouped(docs, scratch)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "of")).alias("least")
    first = scratch.keep(fps.join(groups, "fp").groupBy("root").agg(least).select(F.col("least.doc_id").alias("_id"), F.col("least.of").alias("_of")), "first")
    own = fps.groupBy("doc_id", "of").agg(F.count("*").alias("n")).where("n > 1")
    repeated = scratch.keep(first.join(own, first["_id"].eqNullSafe(own["doc_id"]) & (first["_of"] == own["of"]), "left_semi"), "repeated")

    def match(table: DataFrame, how: str):
        return lambda df: df.join(table, df["doc_id"].cast("long").eqNullSafe(table["_id"]) & (F.xxhash64(df["text"].cast("string")) == table["_of"]), how)

    kept = docs.transform(match(first, "left_semi"))
    if repeated.isEmpty():
        return kept
    return kept.transform(match(repeated, "left_anti")).union(kept.transform(match(repeated, "left_semi")).dropDuplicates(["doc_id", "text"]))
