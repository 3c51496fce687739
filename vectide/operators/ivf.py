"""IVF-Flat (E17): coarse centres, rows stored by their nearest, and exact scoring in the lists nearest to a query.

The lists are a partition column, so a written index prunes whole files; in memory the list join prunes by key. One list
may hold a large share of the rows: the join is one that adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vectide.errors import require
from vectide.functions.vectors import L2, metric_of, rank_key, score
from vectide.operators.quantizers import kmeans

#: Rows that the centres are fitted on, those with the least hash of id.
SAMPLE = 50_000


@dataclass
class Ivf:
    centres: np.ndarray
    rows: DataFrame  # (list, id, vec)
    metric: str

    @classmethod
    def build(cls, base: DataFrame, lists: int = 64, metric: str = L2, sample: int = SAMPLE, seed: int = 42) -> Ivf:
        taken = base.select(F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        require(taken, "ivf", "no rows to fit")
        centres = kmeans(np.array([r["vec"] for r in taken]), lists, seed=seed)
        return cls(centres, assign(base, centres, 1, "id").withColumnRenamed("lists", "list").select(F.col("list")[0].alias("list"), "id", "vec"), metric_of(metric))

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, rank, id, score) over the `probes` lists nearest to each query."""
        q = assign(queries, self.centres, probes, "query_id").select("query_id", F.col("vec").alias("q"), F.explode("lists").alias("list"))
        scored = self.rows.join(q, "list").select("query_id", "id", score(self.metric, "q", "vec").alias("score")).where("score is not null")
        by = Window.partitionBy("query_id").orderBy(rank_key(self.metric, F.col("score")), "id")
        return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def write(self, path: str) -> None:
        self.rows.write.partitionBy("list").parquet(path)


def assign(df: DataFrame, centres: np.ndarray, n: int, key: str) -> DataFrame:
    """df(key, vec) with the numbers of the n nearest centres, nearest first."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    n = min(n, len(centres))

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        c = shared.value
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        d = (c * c).sum(1)[None] - 2 * x @ c.T
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.select(key, "vec", near(F.col("vec").cast("array<double>")).alias("lists"))
