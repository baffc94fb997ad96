"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.common import stored
from fathomry.session import row_count


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: each component is then a star around its smallest id."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("end"))
    degrees = ends.groupBy("end.node").agg(F.sum("end.out").alias("out"), F.min("end.out").alias("least"))
    return degrees.where("out > 1 or out = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """The component of each node of ``edges`` (u, v: long): node, component (its smallest node).

    Loops, repeated and reversed edges and null ends do no harm (nulls are left out); an empty table gives an empty one.
    Each step is an aggregation and an equi-join on the node, so that a node with very many neighbours is
    pre-aggregated and its join split; steps are written to the shared folder. Their number grows with the
    logarithm of the nodes.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while row_count(e, 1) and not _stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
