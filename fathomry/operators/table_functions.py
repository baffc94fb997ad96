"""Chunkers as table functions of SQL.

``register(spark)``, then ``SELECT d.doc_id, c.* FROM docs d, LATERAL chunks(d.text, 'struct', 450) c``. Null texts count
as empty and give no rows. The functions read no table and shuffle nothing: rows stay in the partition of their document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fathomry.operators import chunking

CHUNKS = "chunk_no int, start int, end int, text string, words int, prov int, refs array<int>, first_unit int, end_unit int, gap boolean, home int, mentions array<string>"
UNITS = "i int, start int, end int, type string, level int, text string, prov int"
PROVISIONS = "pi int, id string, title string, path array<string>, units array<int>, start int, end int"
PACKED = "chunk_no int, text string"


def _rows(schema: str, found: list[dict]) -> Iterator[tuple]:
    names = [field.split()[0] for field in schema.split(", ")[1:]]
    for no, row in enumerate(found):
        yield (no, *(row.get(n) for n in names))


class Chunks:
    """chunks(text, strategy[, size]): the chunks of a strategy that needs no questions."""

    def eval(self, text: str | None, strategy: str, size: int = chunking.LAB_SIZE) -> Iterator[tuple]:
        if strategy not in chunking.STRATEGIES or strategy in chunking.SUPERVISED:
            raise ValueError(f"no strategy of chunks(): {strategy}")
        yield from _rows(CHUNKS, chunking.chunked(text, strategy, size))


class SupervisedChunks:
    """supervised_chunks(text, questions, strategy[, size]): chunks around the evidence of questions (array<array<string>>, null for none)."""

    def eval(self, text: str | None, questions: list | None, strategy: str, size: int = chunking.LAB_SIZE) -> Iterator[tuple]:
        if strategy not in chunking.SUPERVISED:
            raise ValueError(f"no strategy of supervised_chunks(): {strategy}")
        yield from _rows(CHUNKS, chunking.chunked(text, strategy, size, questions))


class Units:
    """document_units(text): headings and sentences with their offsets."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from _rows(UNITS, chunking.parse(text or "")[1])


class Provisions:
    """document_provisions(text): numbered or deep headings with the units under them."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from _rows(PROVISIONS, chunking.parse(text or "")[2])


class Packed:
    """packed_sentences(sentences[, size, overlap]): an array of sentences packed into chunks of about ``size`` characters."""

    def eval(self, parts: list | None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        yield from enumerate(chunking.pack([p for p in parts or [] if p is not None], size, overlap))


FUNCTIONS = {"chunks": (Chunks, CHUNKS), "supervised_chunks": (SupervisedChunks, CHUNKS), "document_units": (Units, UNITS), "document_provisions": (Provisions, PROVISIONS), "packed_sentences": (Packed, PACKED)}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema, useArrow=True))
