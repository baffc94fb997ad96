"""Helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.session import row_count, written

#: A word, as the contracts define it: a run of anything but these six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most this many thin rows (ids and a few numbers) may be broadcast: 16 to 32 MB.
BROADCAST_ROWS = 1_000_000

#: A Python worker splits about so many bytes of text into words at once.
SLICE_BYTES = 1 << 21


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    return written(df, name)


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in stretches of about SLICE_BYTES or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(ends)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield texts.slice(a, b - a)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """For ``split_words``: 0 for a byte of a word, 1 for one between words, 2 for one between pieces."""
    out = np.zeros(256, np.uint8)
    out[list(between)], out[list(breaks)] = 1, 2
    return out


def split_words(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts (binary, A-Z in lower case), the row of each and the number of its piece.

    Texts are cut at ASCII bytes, so letters of several bytes stay whole. No piece spans two texts.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    data, ends = _LOWER[data], ends - ends[0]
    kind = kinds[data]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = word[first]
    at = np.flatnonzero(begins)
    done = np.cumsum(word)
    offsets = np.append(done[at] - 1, done[-1] if len(done) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    row = np.searchsorted(ends, at, side="right") - 1
    return words, row, np.cumsum(kind == 2)[at] + row


def ranked(df: DataFrame, order: list[Column], group: str | None = None, rank: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order``, whose first column is ``group`` if places count by group.

    Rows are range-sorted, so no task holds all of them or a whole group; counts by range give each range its
    base. ``df`` is read twice, so it should be stored. Rows equal in ``order`` meet in one task.
    """
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    name = group or "_all"
    rows = rows if group else rows.withColumn(name, F.lit(0))
    sizes = rows.groupBy(F.col(name).alias("_group"), "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")
    bases = stored(sizes.select("_group", "_range", (before + 1 - F.col("_first")).alias("_base")), "bases").withColumnRenamed("_range", "_own")
    out = rows.join(small_side(bases), rows[name].eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_own")))
    return out.select(*df.columns, (F.col("_at") + F.col("_base")).alias(rank))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, else as it is, for a shuffled join.

    The rows of a stored table are known; anything else is counted, so it should be cheap to read.
    """
    return F.broadcast(df) if row_count(df, limit + 1) <= limit else df


def word_count(text):
    """The number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
