"""Vectors as Column expressions, and hashed bag-of-words embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions.arrow_text import fnv1a, raw_tokens, slices

DIMENSIONS = 1024
SIGN_BIT = 1 << 16


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 where a vector is null or the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(F.size(a) == F.size(b), F.lit(False)), product).otherwise(F.lit(0.0))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    m = magnitude(v)
    return F.when(m > 0, F.transform(v, lambda x: x.cast("double") / m)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: their inner product."""
    return dot(a, b)


def hashed_rows(rows: DataFrame, key: str, text: str, seed: str = "v1|", dims: int = DIMENSIONS) -> DataFrame:
    """Hashed embeddings, one row for each row: key, buckets, weights (the non-zero components of a unit vector).

    Each token adds a sign to the bucket of its hash. Texts without tokens have empty lists. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                tokens, row, _ = raw_tokens(texts)
                coded = tokens.dictionary_encode()
                h = fnv1a(coded.dictionary, seed)[coded.indices.to_numpy()]
                sign = np.where(h & np.uint64(SIGN_BIT), 1, -1)
                keys, at = np.unique(row * dims + (h % np.uint64(dims)).astype(np.int64), return_inverse=True)
                v = np.bincount(at, weights=sign, minlength=len(keys))
                keys, v = keys[v != 0], v[v != 0]
                norm = np.sqrt(np.bincount(keys // dims, weights=v * v, minlength=len(texts)))
                ends = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * dims), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(keys % dims, pa.int32()), pa.array(v / norm[keys // dims], pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *lists], names=[key, "buckets", "weights"])
                done += len(texts)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, buckets array<int>, weights array<double>")


def hashed_sparse(rows: DataFrame, key: str, text: str, seed: str = "v1|", dims: int = DIMENSIONS) -> DataFrame:
    """The same, a row for each component: key, bucket, weight. Each row of ``rows`` is one vector."""
    each = hashed_rows(rows, key, text, seed, dims).select(key, F.explode(F.arrays_zip("buckets", "weights")).alias("c"))
    return each.select(key, F.col("c.buckets").alias("bucket"), F.col("c.weights").alias("weight"))


def dense(sparse: DataFrame, key: str, dims: int = DIMENSIONS) -> DataFrame:
    """Array form of sparse vectors: key, vector (at most ``dims`` components each)."""
    entries = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return entries.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("vector"))
