"""What the two vector searches share: usable rows, groups of equal vectors, blocks, final ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.common import small_side, stored

#: A block holds about so many vectors, and so many queries.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, vector array<double>): rows with an id and a vector of finite components.

    Every row counts, also where rows have one id, equal or not.
    """
    vector = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(vector) > 0)
    return rows.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"))


def query_vectors(rows: DataFrame, condition) -> DataFrame:
    """(query_id, vector) of the rows that meet the condition; an id asks once, with the smallest of its vectors."""
    return rows.where(condition).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each different vector: rep (its smallest vec_id), salt (which of that id's vectors), members, single (whether these are of one id), vector.

    members: its k + 1 smallest vec_ids, each as often as it has the vector, k times at most. More can't be among any query's
    k nearest, since ties go to the smaller vec_id and a query leaves out the rows of its own id only. Rows are counted and the
    rank limit is applied before the shuffles, so copies of one vector don't meet in one task.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.groupBy("vector", "vec_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    own = F.expr(f"array_repeat(vec_id, cast(least(_n, {k}) as int))")
    out = few.groupBy("vector").agg(F.flatten(F.sort_array(F.collect_list(own))).alias("members"), (F.count(F.lit(1)) == 1).alias("single"))
    return out.select(F.col("members")[0].alias("rep"), F.xxhash64("vector").alias("salt"), "members", "single", "vector")


def matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def in_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run(rows, queries)`` on Arrow tables of each block of rows with each block of the queries of equal ``keys``.

    ``rows`` has rep and ``queries`` query_id. Blocks are of bounded size: a hash deals the rows of a key to as
    many blocks as their count asks for. Each side goes to every block of the other, so a task never holds more than one of both.
    """
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    m = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_query_blocks"))
    sizes = small_side(stored(n.join(m, keys), "sizes"))
    left = rows.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64("rep"), F.col("_blocks"))).withColumn("_query_block", F.explode(F.sequence(F.lit(0), F.col("_query_blocks") - 1).cast("array<long>")))
    right = queries.join(sizes, keys).withColumn("_query_block", F.pmod(F.xxhash64("query_id"), F.col("_query_blocks"))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1).cast("array<long>")))
    by = [*keys, "_block", "_query_block"]

    return left.drop("_blocks", "_query_blocks").groupBy(*by).cogroup(right.drop("_blocks", "_query_blocks").groupBy(*by)).applyInArrow(run, schema)


def ranked(found: DataFrame, groups: DataFrame, k: int, order: Column) -> DataFrame:
    """The k first of each query's (query_id, rep, salt, score), with copies: query_id, rank, vec_id, score."""
    each = found.join(groups.select("rep", "salt", "members"), ["rep", "salt"]).select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
