"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, BPE encoding and decoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm import bpe, jaccard, langid, mixing, templates
from fathomry.llm.common import small_side, stored
from fathomry.session import prepared

#: Documents whose language is less certain go, as do those in which there is none.
LEAST_SCORE = 0.5


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a prepared session also when it is called by itself, so that Arrow batches of whole texts stay small."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepared(spark), docs, sf_dir)

    return run


@_prepared
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; ``lang`` is set to it. The model is fitted on a bounded sample of the labelled ones.

    Rows of null or letterless text go; those of null doc_id or lang are judged like others, but teach nothing. Repeated
    rows are judged alike. An empty table gives an empty one, and so does one without labels. Other columns stay.
    """
    found = langid.predict(docs, langid.BackoffModel.fit(docs.where("doc_id is not null")))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@_prepared
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; ``n_chars`` follows the text where lines went.

    No row goes: null and empty texts stay, and a text all of whose lines recur becomes empty. Repeated rows are treated
    alike. An empty table gives an empty one. Other columns stay.
    """
    out = templates.drop_recurring(docs)
    n_chars = F.when(F.col("lines_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


@_prepared
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Of repeated rows (equal doc_id, a null one included, and text) one stays. Rows of null doc_id are compared with no
    other text, those of null or wordless text with none at all: these stay, all of them. An empty table gives an empty one.
    """
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = small_side(stored(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.when(worded, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    left = stored(left.withColumn("_key", key), "left")
    repeated = small_side(stored(left.groupBy("_key").count().where("_key is not null and count > 1").select("_key"), "repeated"))
    once = left.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return left.join(repeated, "_key", "left_anti").unionByName(once).select(*docs.columns)


@_prepared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut where its budget ends.

    Rows of null or wordless text have nothing to take and go. Null sources are one source. Rows of null doc_id are
    ordered by their text. An empty table gives an empty one.
    """
    return mixing.mixed(docs)


@_prepared
def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digests of ids and decoded text, one row for each of ``docs``; null texts count as empty."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sampled models and tokenizers can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
