"""Benchmark decontamination by greedy string tiling.

1. Seeds. Every run of SEED words of a document is hashed by a rolling (Karp-Rabin) hash in NumPy, straight from the
   Arrow buffer, and looked up in a Bloom filter of the benchmark's seeds: two places of a bitmap that has a fixed size
   (2**BITS bits) whatever the benchmark's. It only thins out what is sent on, and lets false hits pass. Of a document
   nothing is sent but the passages whose runs passed, and these once for each distinct text.
2. The hashes that pass are joined with the benchmark's seeds in Spark. What shares a seed is a candidate pair. To reach
   THRESHOLD of an item's words, tiles hold at least THRESHOLD / SEED times as many of its seeds; so all but one of that
   many need not be joined on, and an item leaves out the ones that most items have: a phrase that stands in many items
   and many documents makes no pairs where an item has more of its own.
3. Tiling. For a pair, the longest common run of words that is not marked yet is found by running Karp-Rabin (binary
   search over its length), marked in both, and so on down to runs of SEED words. Tiles may lie in any order, so
   passages that were rearranged are caught. A document is contaminated if the tiles cover THRESHOLD of an item's words.

Words are maximal runs of ASCII letters and digits and of bytes from 0x80, with ASCII letters in lower case; an item
shorter than SEED words is one run of its own length, so it must occur as a whole. Only words of shared seeds can be in a
tile, so tiling looks at these alone; the result is that of tiling the whole text.

The decision depends on a row's text alone. It is tied to the text by 128 bits of its hash, never to an id: rows without
an id, and rows that repeat an id with other texts, are decided one by one.

Edge cases: null and empty texts match nothing; null or repeated doc_ids make no difference; repeated documents get the
same answer each; repeated items count once each, and items without an id as one more in n_items; items without words match
nothing; an empty table of documents gives an empty result and an empty benchmark marks nothing; other columns are ignored
by `contaminated` and kept by `keep_clean`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vectide.llm.scratch import Scratch, let_go, prepare, table

SEED, THRESHOLD, BITS = 5, 0.5, 26
#: Multipliers of the two rolling hashes (odd, so that they can be inverted modulo 2**64).
M_BYTE, M_WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text hashed at once.
AT_ONCE = 1 << 20

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_kind = np.zeros(256, np.uint8)  # the byte of a word in lower case, 0 for what separates words
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _kind[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in a buffer of bytes."""
    low = _kind[data]
    inside = low != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low.astype(np.uint64) * _powers(M_BYTE, len(low)), dtype=np.uint64)))
        back = _powers(_inverse(M_BYTE), len(low) + 1)
        return starts, ends, _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def seed_hashes(words_: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words_) - size + 1), np.uint64)
        for k in range(size):
            out = out * M_WORD + words_[k : k + len(out)]
        return _mix(out)


def _item_seeds(frames):
    """(item, h, size, spare) of the benchmark's runs; `spare` of an item's distinct ones need not be joined on."""
    for f in frames:
        for i, t in zip(f["item"], f["text"], strict=True):
            _, _, w = word_hashes(np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8))
            size = min(SEED, len(w))
            if size:
                h, times = np.unique(seed_hashes(w, size).view(np.int64), return_counts=True)
                places = math.ceil(round(THRESHOLD * len(w) / size, 9))  # that tiles hold at least
                # as few distinct ones as may stand at so many places
                spare = int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), places))
                yield pd.DataFrame({"item": i, "h": h, "size": size, "spare": min(spare, len(h) - 1)})


def _scan(bitmap: np.ndarray, sizes: list[int]):
    """Of rows of text, those that share a hash with the bitmap: the hashes, and the passages that they cover."""
    shift, low_bits = np.uint64(64 - BITS), np.uint64((1 << BITS) - 1)

    def known(slot: np.ndarray) -> np.ndarray:
        slot = slot.astype(np.int64)
        return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).view(bool)

    def found(low: int, high: int, offsets: np.ndarray, data: np.ndarray, hits: list, near: list):
        base = offsets[low]
        starts, ends, h = word_hashes(data[base : offsets[high]])
        owner = np.searchsorted(offsets[low + 1 : high + 1] - base, starts, side="right")
        covered = np.zeros(len(h) + 1, np.int64)
        for size in sizes:
            runs = seed_hashes(h, size)
            ok = np.flatnonzero(known(runs >> shift))
            ok = ok[known(runs[ok] & low_bits)]
            ok = ok[owner[ok] == owner[ok + size - 1]]
            np.add.at(covered, ok, 1)
            np.add.at(covered, ok + size, -1)
            for k in ok.tolist():
                hits[low + owner[k]].add(int(runs[k].view(np.int64)))
        inside = np.cumsum(covered[:-1]) > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1])
        for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True):
            near[low + owner[a]].append(data[base + starts[a] : base + ends[b]].tobytes())

    def batches(stream):
        let_go()
        for b in stream:
            text = [x or b"" for x in b.column("text").cast(pa.large_binary()).to_pylist()]
            # a separator between texts keeps their last and first words apart
            data = b"\n".join(text) + b"\n"
            offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, text), np.int64, len(text)) + 1)))
            data, low = np.frombuffer(data, np.uint8), 0
            hits, near = [set() for _ in text], [[] for _ in text]
            while low < len(text):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + AT_ONCE, side="right")) - 1)
                found(low, high, offsets, data, hits, near)
                low = high
            if keep := [i for i, x in enumerate(hits) if x]:
                at = pa.array(keep)
                columns = [b.column("k").take(at), b.column("l").take(at), pa.array([near[i] for i in keep], pa.list_(pa.binary())), pa.array([sorted(hits[i]) for i in keep], pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["k", "l", "near", "hashes"])

    return batches


def _window(hash_of: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of `size` free words, and their rolling hashes."""
    n = len(hash_of) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[:n])
    with np.errstate(over="ignore"):
        power = _powers(M_WORD, len(hash_of) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hash_of * power[:-1], dtype=np.uint64)))
        # brought to one scale by the power that is left
        return at, _mix((sums[at + size] - sums[at]) * power[len(hash_of) - at])


def tiles(test: list[bytes], doc: list[bytes], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in test, start in doc, words), longest first, earliest first among equals."""
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number) + 1) for w in test], np.uint64)
    b = np.array([number.get(w, 0) for w in doc], np.uint64)
    span = max(len(a), len(b)) + 1
    ha, hb = _mix(a + np.uint64(1)), _mix(b + np.uint64(1))
    # both on the same scale: pad to one length with words that are never free
    ha, hb = np.concatenate((ha, np.zeros(span - len(a), np.uint64))), np.concatenate((hb, np.zeros(span - len(b), np.uint64)))
    free_a, free_b = np.arange(span) < len(a), np.concatenate((b != 0, np.zeros(span - len(b), bool)))
    out: list[tuple[int, int, int]] = []

    def common(size: int):
        at_a, x = _window(ha, free_a, size)
        at_b, y = _window(hb, free_b, size)
        in_b, in_a = np.isin(y, x), np.isin(x, y)
        return at_a[in_a], x[in_a], at_b[in_b], y[in_b]

    low, high = least, len(a)
    while low <= high:
        top, found = low - 1, None
        lo, hi = low, high
        while lo <= hi:
            mid = (lo + hi) // 2
            got = common(mid)
            if len(got[0]):
                top, found, lo = mid, got, mid + 1
            else:
                hi = mid - 1
        if found is None:
            break
        places: dict[int, list[int]] = {}
        before = len(out)
        for j, h in zip(found[2].tolist(), found[3].tolist(), strict=True):
            places.setdefault(h, []).append(j)
        for i, h in zip(found[0].tolist(), found[1].tolist(), strict=True):
            for j in places.get(h, ()):
                if free_a[i : i + top].all() and free_b[j : j + top].all() and (a[i : i + top] == b[j : j + top]).all():
                    out.append((i, j, top))
                    free_a[i : i + top] = free_b[j : j + top] = False
                    break
        high = top if len(found[0]) > 1 and len(out) > before else top - 1  # no tile: hashes met, words did not
    return out


def near_seeds(test: list[bytes], doc: list[bytes], least: int) -> tuple[list[bytes], float]:
    """The words of doc that lie in a seed shared with test, with gaps marked, and the share of test's words that do."""
    places: dict[tuple[bytes, ...], list[int]] = {}
    for i in range(len(test) - least + 1):
        places.setdefault(tuple(test[i : i + least]), []).append(i)
    first = {s[0] for s in places}
    out: list[bytes] = []
    end = 0
    met = np.zeros(len(test) + 1, np.int64)
    for j, w in enumerate(doc):
        if w in first and (seed := tuple(doc[j : j + least])) in places:
            start, stop = max(end, j), j + least
            if start > end:
                out.append(b"")
            out += doc[start:stop] if stop > start else []
            end = max(end, stop)
            for i in places[seed]:
                met[i] += 1
                met[i + least] -= 1
            places[seed] = []  # its places count once
    return out, float((np.cumsum(met[:-1]) > 0).mean()) if test else 0.0


def coverage(test_text: str | None, passages: list[bytes], threshold: float = 0.0) -> tuple[float, int]:
    """Share of the item's words that lie in tiles, and the number of tiles; 0 without tiling if seeds cover less than threshold."""
    test = words(test_text)
    if not test:
        return 0.0, 0
    doc = [w for p in passages for w in [*_WORD.findall(p.lower()), b""]]
    least = min(SEED, len(test))
    near, most = near_seeds(test, doc, least)
    if most < threshold:
        return 0.0, 0
    found = tiles(test, near, least)
    return sum(n for _, _, n in found) / len(test), len(found)


def _tile_batches(threshold: float):
    def batches(frames):
        for f in frames:
            got = [coverage(a, list(b), threshold) for a, b in zip(f["item_text"], f["near"], strict=True)]
            yield pd.DataFrame({"k": f["k"], "l": f["l"], "item_id": f["item_id"], "coverage": [x[0] for x in got], "n_tiles": np.array([x[1] for x in got], np.int64)})

    return batches


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of hash that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(SEED), text)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(k, l, item_id, coverage, n_tiles, n_items): each contaminated text by its text_key, with the item it covers most."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # an item's own key: item_ids may be null or repeated
    items = scratch.keep(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = scratch.keep(items.select("item", "text").mapInPandas(_item_seeds, "item long, h long, size int, spare int"), "seeds")
    # two places a seed, counted from 1 as these functions do, so that a bucket is 4096 whole bytes of the bitmap
    slots = F.explode(F.array(F.shiftrightunsigned("h", 64 - BITS) + 1, F.col("h").bitwiseAND((1 << BITS) - 1) + 1)).alias("s")
    parts = seeds.select(slots).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    bitmap = np.zeros(1 << BITS >> 3, np.uint8)  # 2**BITS bits, at most 2**(BITS-15) rows of 4 KB
    for p in parts:
        bitmap[(p["k"] - 1) * 4096 : p["k"] * 4096] = np.frombuffer(p["bits"], np.uint8)
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]  # at most SEED numbers
    shared = spark.sparkContext.broadcast(bitmap)
    text = F.col("text").cast("string")
    rows = docs.where("text is not null").select(*(c.alias(n) for c, n in zip(text_key(text), "kl", strict=True)), text.alias("text"))

    def batches(stream):
        yield from _scan(shared.value, sorted(sizes))(stream)

    hits = rows.mapInArrow(batches, "k long, l long, near array<binary>, hashes array<long>")
    hits = scratch.keep(hits.groupBy("k", "l").agg(F.first("near").alias("near"), F.first("hashes").alias("hashes")), "hits")
    # the seeds that an item is joined on: without the `spare` ones that most items have, if THRESHOLD is to be reached
    often = seeds.join(seeds.groupBy("h").agg(F.count("*").alias("n")), "h")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "h"))
    joined = scratch.keep(often.withColumn("rank", rank).where((F.col("rank") > F.col("spare")) | F.lit(threshold < THRESHOLD)).select("item", "h"), "joined")
    pairs = scratch.keep(hits.select("k", "l", F.explode("hashes").alias("h")).join(joined, "h").select("k", "l", "item").distinct(), "pairs")
    texts = pairs.join(hits.select("k", "l", "near"), ["k", "l"]).join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    tiled = texts.select("k", "l", "item_id", "near", "item_text").mapInPandas(_tile_batches(threshold), "k long, l long, item_id long, coverage double, n_tiles long")
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.coalesce("item_id", F.lit((1 << 63) - 1))))
    worst = tiled.where(F.col("coverage") >= threshold).groupBy("k", "l").agg(best.alias("best"), F.count_distinct(F.coalesce("item_id", F.lit(-1 << 63))).alias("n_items"))
    return scratch.keep(worst.select("k", "l", "best.*", "n_items"), "found")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with whether it holds a benchmark item, which it covers most, and how far."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", *(c.alias(n) for c, n in zip(text_key(F.col("text").cast("string")), "kl", strict=True)))
    out = rows.join(found, ["k", "l"], "left")
    return out.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; each row is decided by its own text."""
    found = contaminated(docs.select("text"), benchmark)
    first, second = text_key(docs["text"].cast("string"))
    return docs.join(found, (first == found["k"]) & (second == found["l"]), "left_anti")
