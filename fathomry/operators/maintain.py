"""Keeping an index in step with its sources: hash diffs, versions, garbage collection, models, reconciliation, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions.text import fnv_hex

VECTORS, VECTORS_PER_SECOND = 20_000_000, 2_000


def content_hash(text: Column, identity_only: bool = True) -> Column:
    """A digest of the content; the 32-bit one that printed hashes show, if asked for."""
    return F.sha2(F.coalesce(text, F.lit("")), 256) if identity_only else fnv_hex(text)


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new chunks (doc_id, pos, text) with hash and ``reused``: whether the old ones hold that content for them.

    A multiset match: the n-th chunk of one content reuses the n-th old chunk of it.
    """
    def numbered(rows: DataFrame) -> DataFrame:
        hashed = rows.withColumn("hash", content_hash(F.col("text")))
        return hashed.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("pos")))

    had = numbered(old).select("doc_id", "hash", "copy", F.lit(True).alias("had"))
    return numbered(new).join(had, ["doc_id", "hash", "copy"], "left").select("doc_id", "pos", "text", "hash", F.coalesce("had", F.lit(False)).alias("reused"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """doc_id, n_chunks, embedded (not reused), first_change (position, null without one), cascade (chunks from there on)."""
    first = F.min(F.when(~F.col("reused"), F.col("pos")))
    return diff.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(~F.col("reused")).alias("embedded"), first.alias("first_change"), F.coalesce(F.count(F.lit(1)) - first, F.lit(0)).alias("cascade"))


def replaced(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Pairs of the n-th chunk that went with the n-th that came in each document: doc_id, n, deleted, inserted."""
    def left_over(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        rows = hash_diff(a, b).where("not reused")
        return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("n"), F.col("text").alias(name))

    return left_over(new_chunks, old_chunks, "deleted").join(left_over(old_chunks, new_chunks, "inserted"), ["doc_id", "n"], "full")


def reindexed(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the documents in ``fresh`` (same columns) replaced; nothing else is touched."""
    return rows.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").select(*rows.columns).unionByName(fresh)


def write_version(active_rows: DataFrame, chunks: DataFrame, version: int, embed) -> DataFrame:
    """Rows of a new version (doc_id, pos, text, hash, vector, version): vectors of equal content are copied, the rest embedded.

    ``embed`` maps a text Column to a vector Column.
    """
    known = active_rows.groupBy("doc_id", "hash").agg(F.first("vector").alias("known"))
    rows = chunks.withColumn("hash", content_hash(F.col("text"))).join(known, ["doc_id", "hash"], "left")
    need = F.when(F.col("known").isNull(), F.col("text"))
    return rows.select("doc_id", "pos", "text", "hash", F.coalesce("known", embed(need)).alias("vector"), F.lit(version).alias("version"))


def searchable(rows: DataFrame, active: DataFrame) -> DataFrame:
    """The rows of each document's active version (doc_id, version)."""
    return rows.join(active.select("doc_id", "version"), ["doc_id", "version"], "left_semi")


def activated(active: DataFrame, rows: DataFrame, expected: DataFrame) -> DataFrame:
    """The pointer table after activation: a document moves to ``expected`` (doc_id, version, n_rows) only when all its rows are visible."""
    landed = rows.where("visible").groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("landed"))
    ready = expected.join(landed, ["doc_id", "version"]).where("landed >= n_rows").select("doc_id", F.col("version").alias("ready"))
    return active.join(ready, "doc_id", "full").select("doc_id", F.coalesce("ready", "version").alias("version"))


def coverage(rows: DataFrame, active: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, coverage: the share of each document's rows that readers of its active version see."""
    seen = searchable(rows.where("visible"), active).groupBy("doc_id").agg(F.count(F.lit(1)).alias("seen"))
    return expected.join(seen, "doc_id", "left").select("doc_id", F.least(F.lit(1.0), F.coalesce("seen", F.lit(0)) / F.greatest("n_rows", F.lit(1))).alias("coverage"))


def collected(rows: DataFrame, active: DataFrame, keep: int = 1) -> DataFrame:
    """Garbage collection: rows of versions older than the active one by more than ``keep`` go. Running it again changes nothing."""
    current = active.select("doc_id", F.col("version").alias("_active"))
    return rows.join(current, "doc_id").where(F.col("version") >= F.col("_active") - keep).select(*rows.columns)


def gc_series(edits: DataFrame, every: int = 10, keep: int = 1) -> DataFrame:
    """doc_id, edit, total_rows, stale_rows, kept_rows, kept_stale after every so many edits (doc_id, edit, n_chunks).

    Each edit writes a whole version. Totals are running sums; with collection only ``keep`` old versions stay.
    """
    w = Window.partitionBy("doc_id").orderBy("edit")
    out = edits.withColumn("total_rows", F.sum("n_chunks").over(w)).withColumn("kept_rows", F.sum("n_chunks").over(w.rowsBetween(-keep, 0)))
    out = out.where(F.col("edit") % every == 0)
    return out.select("doc_id", "edit", "total_rows", (F.col("total_rows") - F.col("n_chunks")).alias("stale_rows"), "kept_rows", (F.col("kept_rows") - F.col("n_chunks")).alias("kept_stale"))


def model_mix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))


def of_model(rows: DataFrame, model: str) -> DataFrame:
    """Serving pinned to one embedding model."""
    return rows.where(F.col("model") == model)


def drift(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """doc_ids whose source's hash isn't the indexed one, missing ones included (doc_id, hash on both sides)."""
    return sources.join(indexed, ["doc_id", "hash"], "left_anti").select("doc_id")


def reconciled(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """The index's hashes after a sweep that repairs drifted documents and drops those without a source."""
    stale = drift(sources, indexed)
    fresh = sources.join(stale, "doc_id", "left_semi").select("doc_id", "hash")
    kept = indexed.join(stale, "doc_id", "left_anti").join(sources.select("doc_id"), "doc_id", "left_semi")
    return kept.select("doc_id", "hash").unionByName(fresh)


def cache_lookup(cache: DataFrame, active: DataFrame) -> DataFrame:
    """Cache entries (key, answer, sources map doc_id -> version) with ``valid``: every source is still at that version."""
    parts = cache.select("key", F.explode("sources").alias("doc_id", "cached_version")).join(active, "doc_id", "left")
    same = F.coalesce(F.col("version") == F.col("cached_version"), F.lit(False))
    valid = parts.groupBy("key").agg(F.bool_and(same).alias("ok"))
    return cache.join(valid, "key", "left").select("key", "answer", F.coalesce("ok", F.lit(True)).alias("valid"))


def cacheable(responses: DataFrame) -> DataFrame:
    """Responses that may be stored: those that aren't flagged."""
    return responses.where(~F.coalesce(F.col("flagged"), F.lit(False)))


def projection_seconds(embeddings: Column) -> Column:
    return embeddings / VECTORS_PER_SECOND
