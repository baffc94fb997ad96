"""The best few candidates of each query as a partial aggregate: a task hands on only what may be among them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared to so many digits, so that the order of summation makes no difference.
DIGITS = 9


def top(scored: DataFrame, k: int, by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(by, DIGITS).desc(), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class Best:
    """The k best (score, id) of each of ``n`` queries that a task has seen; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)  # what a score must reach, to DIGITS digits

    def offer(self, query: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of one query and the ids they belong to."""
        rounded = np.floor(scores * 10**DIGITS + 0.5)
        at = np.flatnonzero(rounded >= self.least[query])
        if len(at) > self.k:
            at = at[rounded[at] >= np.partition(rounded[at], -self.k)[-self.k]]
        if not len(at):
            return
        new = zip((-rounded[at]).tolist(), ids.take(pa.array(at)).to_pylist(), scores[at].tolist(), strict=True)
        best = sorted([*self.found[query], *new], key=lambda x: x[:2])[: self.k]
        self.found[query] = best
        if len(best) == self.k:
            self.least[query] = -best[-1][0]

    def rows(self, query_ids: list, query_kind: pa.DataType, kind: pa.DataType) -> pa.RecordBatch:
        each = [(q, x[1], x[2]) for q, own in zip(query_ids, self.found, strict=True) for x in own]
        columns = list(zip(*each, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], query_kind), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], names=["query_id", "chunk_id", "score"])
