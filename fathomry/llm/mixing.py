"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs.

Each document gets a random key from a hash of its doc_id. A source is the range of its keys; the key's leading
digits cut this range into buckets, whose sums are pre-aggregated. The prefix sum of a document is its bucket's
base plus a running sum within the bucket, so that no task sorts a whole source. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.common import small_side, stored, word_count

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST_EPOCHS = 3
#: A bucket is to hold about so many rows at most. Results don't depend on it.
BUCKET_ROWS = 1 << 14


def targets(sources: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row for each source.

    The targets share the sum of all sizes by weight, but none is above ``most_epochs`` times its source's size;
    what is above is reshared by weight. With the sources in order of limit / weight, those before the first
    that its share doesn't fill are at their limits, and the rest share what these leave. The windows hold one
    row for each source, of which a task must hold all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    out = sources.select("source", "source_size", weight.alias("weight")).withColumn("limit", F.col("source_size") * most_epochs).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    out = out.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole)
    return out.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, text_hash, source, size, source_size, target, taken. ``taken`` counts words: each full epoch
    takes a document whole, the last one ends exactly at the source's budget (its target, rounded), within a document
    if need be. Null and empty texts have size 0 and take 0; a null source is a source; rows whose doc_id is null
    are ordered by their text's digest; repeated rows count each, and which of two equal rows comes first makes
    no difference. An empty table gives an empty result. Reruns agree. Other columns are not read.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    digits = max(1, math.ceil(math.log(max(1, rows.count() / BUCKET_ROWS), 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    budget, whole = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    goals = goals.withColumn("epochs", F.floor(budget / whole)).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    base = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    plan = stored(_same(sums.withColumn("base", base), goals, ["source"]), "plan")
    rows = _same(rows, small_side(plan.drop("words")), ["source", "bucket"])
    before = F.col("base") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = F.least("size", F.greatest(F.lit(0), F.col("rest") - before))
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null equals null; keeps the left keys."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = None
    for k in keys:
        on = left[k].eqNullSafe(right[f"_{k}"]) if on is None else on & left[k].eqNullSafe(right[f"_{k}"])
    return left.join(right, on).drop(*[f"_{k}" for k in keys])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once for each time it is taken, with the columns of ``docs``.

    The document in which a source's budget ends is there with its first words only, joined by spaces; a column
    n_chars then follows the text. Equal rows (of one doc_id, text and source) share what they take in equal whole words;
    words left over, fewer than there are such rows, follow in further copies of one of them. So the mix has each
    source's budget to the word. Rows of null or empty text aren't taken. An empty table gives an empty result.
    """
    names = docs.columns
    taken = mix(docs, **options)
    share = F.floor(F.sum("taken") / F.count(F.lit(1)))
    each = taken.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), F.col("source").alias("_source"))
    each = stored(each.agg(F.first("size").alias("_size"), share.alias("_taken"), (F.sum("taken") - share * F.count(F.lit(1))).alias("_left")), "taken")
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    key = rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["_hash"] == F.col("_text")) & rows["source"].eqNullSafe(F.col("_source"))
    left = rows.join(small_side(each.where("_left > 0")), key).dropDuplicates(["_doc", "_text", "_source"]).withColumn("_taken", F.col("_left"))
    rows = rows.join(each.where("_taken > 0"), key).unionByName(left)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    cut = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, words), " ")
    rows = rows.withColumn("text", F.when(words < F.col("_size"), cut).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)


#: mix() over ``documents``.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), md5(text), '')) AS key
  FROM documents),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources),
ratios AS (SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS ratio FROM weighted),
levels AS (
  SELECT *, CAST(SUM(source_size) OVER () - COALESCE(SUM(cap) OVER w, 0) AS DOUBLE)
            / CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0) AS DOUBLE) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         LEAST(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio)) AS target
  FROM levels),
plans AS (
  SELECT *, CAST(round(target) AS BIGINT) // GREATEST(source_size, 1) AS epochs FROM goals),
placed AS (
  SELECT doc_id, size, s.source, SUM(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + LEAST(size, GREATEST(0, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed JOIN plans ON placed.source IS NOT DISTINCT FROM plans.source
"""
