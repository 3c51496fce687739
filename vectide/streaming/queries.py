"""Query streams (S6): bounded batches of queries from a streaming source or from a pipe, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.errors import require
from vectide.functions.vectors import L2
from vectide.operators.exact import topk
from vectide.sources.vecfiles import FORMATS


def query_source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of queries(query_id, vec) from Parquet files that arrive in a folder; a batch is bounded by files."""
    return spark.readStream.schema("query_id long, vec array<double>").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Starts a query that writes answer(batch) to `sink` as Parquet, one folder per batch, so a batch that is run again
    after a failure replaces its own output."""

    def one(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_stream(base: DataFrame, queries: DataFrame, k: int, sink: str, checkpoint: str, metric: str = L2):
    """Exact search over a stream of queries."""
    return answer_stream(queries, lambda q: topk(base, q, k, metric), sink, checkpoint)


def piped_queries(spark: SparkSession, stream: BinaryIO, kind: str = "fvecs", batch: int = 1000) -> Iterator[DataFrame]:
    """Batches of at most `batch` queries(query_id, vec) from a stream of rows that each begin with their dimension, as they come."""
    dtype, where = FORMATS[kind]
    require(where == "row", "read", "a pipe needs rows that begin with their dimension", "UNSUPPORTED", format=kind)
    held: list[tuple[int, list[float]]] = []
    dim, number = None, 0
    while head := stream.read(4):
        own = int(np.frombuffer(head, "<u4")[0]) if len(head) == 4 else -1
        require(own > 0 and dim in (None, own), "read", "rows differ in dimension, or the stream ends within one", "INVALID_DATA", row=number)
        dim = own
        raw = stream.read(dim * np.dtype(dtype).itemsize)
        require(len(raw) == dim * np.dtype(dtype).itemsize, "read", "the stream ends within a row", "INVALID_DATA", row=number)
        held.append((number, np.frombuffer(raw, dtype).astype(np.float64).tolist()))
        number += 1
        if len(held) == batch:
            yield spark.createDataFrame(held, "query_id long, vec array<double>")
            held = []
    if held:
        yield spark.createDataFrame(held, "query_id long, vec array<double>")
