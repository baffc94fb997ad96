"""Readers: text files, extracted pages, markup, questions with evidence; dispatch by file type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.text import squash

HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->"
PAIRS = "array<struct<split:string,q:string,evidence:array<string>>>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name), page 1, text: each file as one page."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("doc_id"), F.lit(1).alias("page"), F.col("value").alias("text"))


def is_pdf(name: Column, mime: Column | None = None) -> Column:
    by_name = F.lower(name).endswith(".pdf")
    return by_name if mime is None else by_name | (mime == "application/pdf")


def pages(items: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) from extracted items (doc_id, page, items array<string>): joined, squashed, never empty."""
    text = squash(F.array_join("items", " "))
    empty = F.concat(F.lit("[Empty page "), F.col("page").cast("string"), F.lit("]"))
    return items.select("doc_id", "page", F.when(text == "", empty).otherwise(text).alias("text"))


def binary_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id, page, text of binary files by an extractor that returns a file's page texts. PDF files are one case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, k, t) for name, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True) for k, t in enumerate(extract(data), 1)]
            name, page, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(page, pa.int32()), pa.array(text, pa.string())], names=["doc_id", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), "content")
    found = files.mapInArrow(run, "doc_id string, page int, text string")
    return pages(found.select("doc_id", "page", F.array("text").alias("items")))


def files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Text files and, with an extractor, PDF files of a folder."""
    text = text_files(spark, path).where(~is_pdf(F.col("doc_id")))
    return text.unionByName(binary_files(spark, path, extract).where(is_pdf(F.col("doc_id")))) if extract else text


def question_pairs(rows: DataFrame, column: str = "value") -> DataFrame:
    """qi, split, q, evidence from JSON arrays of questions; a text that is no such array gives no row."""
    parsed = rows.select(F.from_json(F.col(column), PAIRS).alias("pairs"))
    return parsed.select(F.posexplode("pairs").alias("qi", "p")).select("qi", "p.split", "p.q", "p.evidence").where("q is not null")


def markup_text(html: Column) -> Column:
    """The visible text of a page's markup, headings as markdown."""
    out = F.regexp_replace(html, HIDDEN, " ")
    out = F.regexp_replace(out, r"(?i)<h([1-6])[^>]*>", "\n\n### ")
    out = F.regexp_replace(out, r"(?i)<(?:p|div|li|br|tr|/h[1-6])\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
