"""The training-data operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm import ann, bpe, chat, jaccard, langid, lengths, mixing, packing, phrases, resample, templates, url_lists, vafile
from fathomry.llm.common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of fetching: a rule gives each one in 2024. The list is a fixed one and one that grows with the hosts."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.cast("timestamp").alias("fetched_at"))
    fixed = spark.createDataFrame(list(url_lists.LISTED), "pattern string, action string, change string, day string")
    fixed = fixed.select("pattern", "action", "change", F.col("day").cast("timestamp").alias("at"))
    return url_lists.evaluate(captures, fixed.unionByName(url_lists.listed_hosts(captures)))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_products(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learned from a bounded sample; what is parsed are texts in order of turn, without their roles."""
    rows = table(spark, sf_dir, "conversations")
    return chat.parse(rows.select("conv_id", "turn", "text"), chat.fit(rows)).select("conv_id", "turn", "part", "role", "rendered")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("text")
    counted = lengths.encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lengths.sums(stored(lengths.histogram(counted), "histogram"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.drop_recurring(docs).select("doc_id", "lines_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.in_fold(0, 5)
    model = langid.BackoffModel.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.packed(cut).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_OPERATORS = (op1_url_lists, op2_nearest_neighbours, op3_mix_sources, op4_exact_top_k, op5_chat_turns, op6_token_counts, op7_line_dedup, op8_language_id, op9_bpe, op10_jaccard_join, op11_best_fit_packing, op12_importance_resampling, op13_phrases)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL = {"op1_url_lists": url_lists.SQL, "op3_mix_sources": mixing.SQL, "op4_exact_top_k": vafile.SQL, "op12_importance_resampling": resample.SQL, "op13_phrases": phrases.SQL}
