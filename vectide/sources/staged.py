"""Staged graph files (S10, G16): the binary exchange format of partitioned graphs, versions 3 and 4.

Little-endian u32 words. Version 3: magic, 3, points, max_degree, max_extra, entry. Version 4: magic, 4, length of a JSON
descriptor, the descriptor. Then one row per node: counts of local, remote and extra, and their ids in this order.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vectide.errors import require
from vectide.operators.graph import SCHEMA
from vectide.sources import store

#: Fixed value: the first word of a staged file.
MAGIC = 0x53544147


def write_staged(path: str, graph: DataFrame, entry: int, descriptor: dict | None = None) -> None:
    """Writes a graph, streamed to the driver in order of node; version 4 with a descriptor, else 3."""
    shape = graph.selectExpr("count(*) n", "max(size(local) + size(remote)) d", "max(size(extra)) e").first()
    head = [MAGIC, 3, shape["n"], shape["d"] or 0, shape["e"] or 0, entry]
    if descriptor is None:
        start = np.array(head, "<u4").tobytes()
    else:
        text = json.dumps(descriptor | {"points": shape["n"], "max_degree": shape["d"], "max_extra": shape["e"], "entry": entry}).encode()
        require(len(text) <= 16384, "write_staged", "descriptor is too long")
        start = np.array([MAGIC, 4, len(text)], "<u4").tobytes() + text

    def data():
        held = [start]
        for r in graph.orderBy("node").toLocalIterator():
            held.append(np.array([len(r["local"]), len(r["remote"]), len(r["extra"]), *r["local"], *r["remote"], *r["extra"]], "<u4").tobytes())
            if len(held) >= 4096:
                yield b"".join(held)
                held = []
        yield b"".join(held)

    store.write(graph.sparkSession, path, data())


def read_staged(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The graph table and its descriptor; trailing bytes, truncation and bad ids are errors."""
    raw = store.read(spark, path)
    bad = lambda message: require(False, "read_staged", message, "INVALID_DATA", path=path)
    if len(raw) < 12:
        bad("file is truncated")
    magic, version, third = np.frombuffer(raw[:12], "<u4").tolist()
    if magic != MAGIC or version not in (3, 4):
        bad("not a staged graph of version 3 or 4")
    if version == 3:
        about, at = dict(zip(("points", "max_degree", "max_extra", "entry"), np.frombuffer(raw[8:24], "<u4").tolist(), strict=True)), 24
    else:
        if not 1 <= third <= 16384:
            bad("descriptor length is out of range")
        about, at = json.loads(raw[12 : 12 + third].decode()), 12 + third
    if (len(raw) - at) % 4:
        bad("file is truncated")
    words, k, rows = np.frombuffer(raw[at:], "<u4").astype(np.int64), 0, []
    for node in range(about["points"]):
        if k + 3 > len(words):
            bad("file is truncated")
        a, b, c = words[k : k + 3].tolist()
        k += 3
        if k + a + b + c > len(words) or a + b > about["max_degree"] or c > about["max_extra"]:
            bad("row exceeds its capacity or the file")
        ids = words[k : k + a + b + c]
        if len(ids) and (ids.max() >= about["points"] or node in ids or len(np.unique(ids)) < len(ids)):
            bad("id out of range, self-edge or duplicate")
        rows.append((node, ids[:a].tolist(), ids[a : a + b].tolist(), ids[a + b :].tolist()))
        k += a + b + c
    if k != len(words):
        bad("trailing bytes")
    return spark.createDataFrame(rows, SCHEMA), about
