"""Exact top-k inner products by vector-approximation files.

Each component is replaced by the number of its cell among equally filled ones. A scan of these small
approximations bounds every score from both sides; what can't be among the k best goes. The exact vectors of the rest
are read in the order of their bounds: first each query's k best bounds, then those whose bound still reaches
the k-th exact score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.common import stored
from fathomry.llm.vectors import distinct_vectors, in_blocks, matrix, query_vectors, ranked, usable

#: Cells of each dimension.
CELLS = 64
SCALE = 1024
#: Below, the product of two vectors' lengths bounds every sum of products within a long; above, decimals add them up.
SAFE = float(1 << 62)


def cell_bounds(groups: DataFrame, cells: int = CELLS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the lowest and the highest value of each dimension's cells, from quantiles over all rows."""
    each = groups.select(F.size("vector").alias("dim"), F.posexplode("vector").alias("pos", "x"))
    shares = [k / cells for k in range(1, cells)]
    rows = each.groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", shares, 2_000).alias("cuts"))
    out: dict[int, list] = {}
    for r in rows.orderBy("dim", "pos").toLocalIterator():  # one row for each dimension
        out.setdefault(r.dim, []).append((r.low, r.cuts, r.high))
    # A cell holds the values above the cut before it up to its own cut.
    return {d: (np.array([[low, *[c + 1 for c in cuts]] for low, cuts, _ in rs], float), np.array([[*cuts, high] for _, cuts, high in rs], float)) for d, rs in out.items()}


def approximations(groups: DataFrame, bounds) -> DataFrame:
    """rep, salt, single, dim, cells: one byte for each component instead of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                x, highs = matrix(pa.chunked_array([part.column("vector")])), bounds.value[dim][1]
                cells = np.stack([np.searchsorted(highs[j, :-1], x[:, j]) for j in range(dim)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("salt"), part.column("single"), pa.array(np.full(len(x), dim, np.int32)), pa.array([c.tobytes() for c in cells], pa.binary())], names=["rep", "salt", "single", "dim", "cells"])

    return groups.select("rep", "salt", "single", "vector").mapInArrow(run, "rep long, salt long, single boolean, dim int, cells binary")


def _bounded(k: int, bounds):
    """The approximations of a block that can be among a query's k best in it, with their bounds."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "rep": [], "salt": [], "low": [], "high": []}
        if rows.num_rows and queries.num_rows:
            dim = rows.column("dim")[0].as_py()
            cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
            lows, highs = (b[np.arange(dim), cells] for b in bounds.value[dim])
            rep, salt, single = (rows.column(c).to_numpy() for c in ("rep", "salt", "single"))
            most = max(np.abs(lows).max(), np.abs(highs).max())
            ids = queries.column("query_id").to_numpy()
            for start in range(0, len(ids), 128):
                q = matrix(queries.column("vector").slice(start, 128))
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                slack = np.abs(q).sum(axis=1, keepdims=True) * most * 2.0**-44
                high, low = up @ highs.T + down @ lows.T + slack, up @ lows.T + down @ highs.T - slack
                own = (rep[None, :] == ids[start : start + 128, None]) & single[None, :]
                low[own] = high[own] = -np.inf
                least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
                i, j = np.nonzero((high >= least[:, None]) & ~own)
                for name, values in (("query_id", ids[start + i]), ("rep", rep[j]), ("salt", salt[j]), ("low", low[i, j]), ("high", high[i, j])):
                    out[name].append(values)
        kinds = {"query_id": np.int64, "rep": np.int64, "salt": np.int64, "low": np.float64, "high": np.float64}
        return pa.table({n: pa.array(np.concatenate([np.empty(0, kinds[n]), *v]).astype(kinds[n])) for n, v in out.items()})

    return run


def top_products(vectors: DataFrame, queries, k: int = 10, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """The k highest inner products of floor(scale * x) vectors for each query: query_id, rank, vec_id, score (long).

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id. Rows whose vector is null, empty or
    holds null or non-finite components take no part, nor do rows without an id. Every other row is a candidate, repeated
    rows as often as they stand there, but for the rows of the query's own id. An id asks once: of several vectors the
    smallest. A component or a candidate's score beyond a long raises an error. A query is scored against vectors of its
    own length; ties go to the smaller vec_id. Other columns are not read. An empty table gives an empty result.
    """
    large = F.raise_error(F.lit("a scaled component leaves the range of a long")).cast("long")
    scaled = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**63 / scale, F.floor(x * float(scale)).cast("long")).otherwise(large))
    rows = stored(usable(vectors).select("vec_id", scaled.alias("vector")), "vectors")
    groups = stored(distinct_vectors(rows, k), "groups")
    bounds = rows.sparkSession.sparkContext.broadcast(cell_bounds(groups, cells))
    file = stored(approximations(groups, bounds), "cells")
    asked = query_vectors(rows, queries).withColumn("dim", F.size("vector"))
    found = stored(in_blocks(file, asked, ["dim"], _bounded(k, bounds), "query_id long, rep long, salt long, low double, high double"), "bounds")

    by_low = Window.partitionBy("query_id").orderBy(F.col("low").desc(), "rep", "salt")
    kth = found.withColumn("r", F.row_number().over(by_low)).where(F.col("r") == k).select("query_id", F.col("low").alias("least"))
    left = found.join(kth, "query_id", "left").where("least is null or high >= least").select("query_id", "rep", "salt", "high")
    by_high = Window.partitionBy("query_id").orderBy(F.col("high").desc(), "rep", "salt")
    left = stored(left.withColumn("r", F.row_number().over(by_high)), "left")

    def exact(some: DataFrame) -> DataFrame:
        length = "sqrt(aggregate({}, 0D, (s, x) -> s + cast(x as double) * x))"
        plain = "aggregate(zip_with(a, b, (x, y) -> x * y), 0L, (s, x) -> s + x)"
        wide = "cast(aggregate(zip_with(a, b, (x, y) -> cast(cast(x as decimal(19,0)) * cast(y as decimal(19,0)) as decimal(38,0))), cast(0 as decimal(38,0)), (s, x) -> cast(s + x as decimal(38,0))) as long)"
        product = F.expr(f"if({length.format('a')} * {length.format('b')} < {SAFE}D, {plain}, {wide})")
        pairs = some.join(groups.select("rep", "salt", F.col("vector").alias("a")), ["rep", "salt"]).join(asked.select("query_id", F.col("vector").alias("b")), "query_id")
        return pairs.select("query_id", "rep", "salt", product.alias("score"))

    first = stored(exact(left.where(F.col("r") <= k)), "exact")
    certain = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    more = exact(left.where(F.col("r") > k).join(certain, "query_id").where("high >= least"))
    return ranked(first.unionAll(more), groups, k, F.col("score").desc())


#: top_products() over ``embeddings``, by brute force; an id asks once.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 10
"""
