"""Best-fit packing of token sequences: bulk-synchronous best-fit decreasing.

Documents are encoded once, without a shuffle, and cut into pieces; what is packed are thin rows (row, length). Steps
take the pieces by length, the longest first. In a round of a step, pieces and the gaps of the open sequences are range-sorted
together, largest first. Each range is swept: a piece goes into the smallest gap of the range that holds it, its successor,
and what is left of the gap goes on. Pieces and gaps left over in their ranges have ranks there; a piece's next gaps are the
last unused ones of the ranges above. From each range's counts (one row a range) follows which ranks of pieces meet
which ranks of gaps, so that no two claim the same room; an equi-join carries this out. Gaps are updated and the round
repeats while some gap holds a piece. Then the step's other pieces open sequences, by next-fit in order of length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.bpe import byte_symbols
from fathomry.llm.common import ranked, stored

#: Tokens of a sequence; the token that ends a document.
CAPACITY, END = 1_024, 2
#: A step takes the pieces of which at least so many fit a sequence, but not as many as in the next step.
STEPS = (1, 2, 3, 4, 6, 10, 20, 60, 200)
#: Texts with white space of this length go to the tokenizers library, as the other's pattern would overflow its stack.
LONG_RUN = 2_000
_RUNS = re.compile(rf"\s{{{LONG_RUN}}}")
#: Pieces of an Arrow batch.
BATCH_PIECES = 1 << 15
_GAP, _PIECE, _PLACED = 0, 1, 2
_SWEPT = "kind int, id long, sequence_id long, value int, offset int, part int, idx long"


class ByteLevelBpe:
    """Encodes as the tokenizers library does with one byte-level file (JSON); by tiktoken, which is faster, where its ids are the ranks of its merges.

    The two agree on every code point (a test compares them); texts with very long white space and other files
    go to the library itself.
    """

    def __init__(self, spec: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact, parsed = Tokenizer.from_str(spec), json.loads(spec)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast, self.special = None, {x["content"]: x["id"] for x in parsed["added_tokens"]}
        model, before = parsed["model"], parsed["pre_tokenizer"] or {}
        byte = {s: b for b, s in enumerate(byte_symbols())}
        own = {t: i for t, i in model["vocab"].items() if t not in self.special}
        order = [own.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not parsed["normalizer"] and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in parsed["added_tokens"])
        if plain and None not in order and order == sorted(order) and all(c in byte for t in own for c in t):
            ranks = {bytes(byte[c] for c in t): i for t, i in own.items()}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or _RUNS.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


_loaded: dict[int, ByteLevelBpe] = {}


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces of each document of ``docs`` (doc_id, text): doc_id, piece (from 0), start, length, ids_crc32, and ``ids`` if asked for.

    A document is its text's ids and ``end``; a null or empty text is ``end`` alone. One of more than ``capacity`` tokens is cut
    into pieces of ``capacity``, of which the first may be shorter. ``ids_crc32`` is that of the ids as little-endian
    32-bit numbers. Repeated rows give pieces each; other columns are not read. ``path`` is a file on the driver, sent to the executors.
    """
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(sent.value)) not in _loaded:
            _loaded.clear()
            _loaded[key] = ByteLevelBpe(*sent.value)
        rows = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.append(_loaded[key].encode(text.as_py()), np.uint32(end)).astype("<u4")
                edges = [0, *range(len(own) % capacity or min(capacity, len(own)), len(own), capacity), len(own)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(own[a:b].tobytes()), *[own[a:b].astype(np.int32)] * ids))
                if len(rows) >= BATCH_PIECES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * ids)


def _sweep(capacity: int):
    """Sweeps one range of gaps and pieces, largest first: pieces placed, and what is left of both, with its rank where others may use it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rooms, mask, left, low = TaskContext.get().partitionId(), {}, 0, 0, 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:5], pa.array([part] * len(rows), pa.int32()), arrays[5]], names=["kind", "id", "sequence_id", "value", "offset", "part", "idx"])

        for batch in batches:
            out = []
            for kind, own, value in zip(batch.column("kind").to_pylist(), batch.column("id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                low = value
                if kind == _GAP:
                    rooms.setdefault(value, []).append(own)
                    mask |= 1 << value
                elif fits := mask >> value:
                    gap = value + (fits & -fits).bit_length() - 1
                    sequence = rooms[gap].pop()
                    if not rooms[gap]:
                        mask ^= 1 << gap
                    if rest := gap - value:
                        rooms.setdefault(rest, []).append(sequence)
                        mask |= 1 << rest
                    out.append((_PLACED, own, sequence, value, capacity - gap, None))
                else:
                    out.append((_PIECE, own, None, value, None, left))
                    left += 1
            yield made(out)
        out, left = [], 0
        for gap in sorted(rooms):
            for sequence in rooms[gap]:
                out.append((_GAP, None, sequence, gap, None, left if gap >= low else None))
                left += gap >= low
            if len(out) >= BATCH_PIECES:
                yield made(out)
                out = []
        yield made(out)

    return run


def _meetings(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """From (part, pieces left, longest, gaps left, smallest) of the ranges, largest first: which ranks of pieces meet which of gaps.

    Rows (part, first, last, gap's part, gap's first, pieces a gap).
    """
    out, open_ = [], []
    for part, n, longest, gaps, smallest in ranges:
        first = 0
        while first < n and open_:
            above, at, end, room = open_[-1]
            each = room // longest
            taken = min(n - first, (end - at) * each)
            out.append((part, first, first + taken - 1, above, at, each))
            first += taken
            at += -(-taken // each)
            open_[-1] = (above, at, end, room)
            if at == end:
                open_.pop()
        if gaps:
            open_.append((part, 0, gaps, smallest))
    return out


def _round(waiting: DataFrame, gaps: DataFrame, capacity: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """One round for pieces (row, length) and gaps (sequence_id, gap): placements, and what is left of both."""
    spark = waiting.sparkSession
    both = gaps.select(F.lit(_GAP).alias("kind"), F.col("sequence_id").alias("id"), F.col("gap").alias("value")).unionAll(waiting.select(F.lit(_PIECE), "row", "length"))
    order = [F.col("value").desc(), F.col("kind").asc(), F.col("id").asc()]
    swept = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep(capacity), _SWEPT), "swept")
    names = [F.col("id").alias("row"), "sequence_id", "offset"]
    placed = [swept.where(F.col("kind") == _PLACED).select(*names)]
    rest = swept.where(F.col("kind") == _GAP).select("sequence_id", F.col("value").alias("gap"), "part", "idx")
    left = swept.where(F.col("kind") == _PIECE).select(F.col("id").alias("row"), F.col("value").alias("length"), "part", "idx")

    here = lambda kind, f: f(F.when((F.col("kind") == kind) & F.col("idx").isNotNull(), F.col("value")))
    ranges = swept.groupBy("part").agg(here(_PIECE, F.count), here(_PIECE, F.max), here(_GAP, F.count), here(_GAP, F.min)).collect()
    meetings = _meetings(sorted(tuple(x) for x in ranges))
    if not meetings:
        return placed, left.select("row", "length"), rest.select("sequence_id", "gap")
    plan = spark.createDataFrame(meetings, "of int, first long, last long, above int, at long, each int")
    met = left.join(F.broadcast(plan), (F.col("part") == F.col("of")) & F.col("idx").between(F.col("first"), F.col("last")), "left")
    met = met.select("row", "length", F.col("above").alias("part"), "at", F.expr("at + (idx - first) div each").alias("idx"), F.col("idx").alias("rank"))
    joined = met.where("part is not null").join(rest.where("idx is not null"), ["part", "idx"])
    upto = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("rank"))
    more = stored(joined.select("row", "sequence_id", (capacity - F.col("gap") + upto - F.col("length")).cast("int").alias("offset"), "length"), "carried")
    used = more.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    rest = rest.join(used, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap"))
    return [*placed, more.select("row", "sequence_id", "offset")], met.where("part is null").select("row", "length"), rest.where("gap > 0")


def _next_fit(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Next-fit of (length, pieces), longest first, into new sequences: by length, where its pieces go.

    Rows (length, first rank, pieces that go on in the last sequence, its number, its filled part, the next sequence's number,
    pieces in each).
    """
    out, rank, last, filled = [], 1, -1, capacity
    for length, n in counts:
        on, each = min(n, (capacity - filled) // length), capacity // length
        out.append((length, rank, on, last, filled, last + 1, each))
        filled += on * length
        if rest := n - on:
            last += -(-rest // each)
            filled = ((rest - 1) % each + 1) * length
        rank += n
    return out


def _opened(waiting: DataFrame, step: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """New sequences for pieces in order of length: placements and gaps."""
    counts = [tuple(x) for x in waiting.groupBy("length").count().collect()]  # at most ``capacity`` rows
    plan = waiting.sparkSession.createDataFrame(_next_fit(sorted(counts, reverse=True), capacity), "length int, first long, on long, last long, filled int, next long, each int")
    placed = ranked(waiting, [F.col("length").desc(), F.col("row").asc()]).join(F.broadcast(plan), "length").withColumn("i", F.expr("rank - first"))
    number = F.expr("if(i < on, last, next + (i - on) div each)")
    offset = F.expr("cast(if(i < on, filled + i * length, (i - on) % each * length) as int)")
    placed = stored(placed.select("row", "length", (-1 - (F.lit(step << 48) + number)).alias("sequence_id"), offset.alias("offset")), "opened")
    gaps = placed.groupBy("sequence_id").agg((capacity - F.sum("length")).cast("int").alias("gap")).where("gap > 0")
    return placed.select("row", "sequence_id", "offset"), gaps


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Where each of ``items`` (row: a long of its own, not negative; length: 1 to ``capacity``) goes: row, sequence_id, offset.

    Sequences hold at most ``capacity`` and are filled from 0 without gaps. An empty table gives an empty one; other
    columns are not read. ``items`` is read in every step, so it should be stored.
    """
    items = items.select("row", F.col("length").cast("int").alias("length"))
    counts = {x["length"]: x["count"] for x in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    steps = [k for k in STEPS if k <= capacity]
    out, gaps = [], None
    for step, each in enumerate(steps):
        high, low = capacity // each, capacity // steps[step + 1] if step + 1 < len(steps) else 0
        own = sorted(x for x in counts if low < x <= high)
        if not own:
            continue
        waiting, least = items.where(F.col("length").between(own[0], own[-1])), min(counts)
        if each == 1:
            out.append(waiting.select("row", F.col("row").alias("sequence_id"), F.lit(0).alias("offset")))
            gaps = stored(waiting.select(F.col("row").alias("sequence_id"), (capacity - F.col("length")).alias("gap")).where(F.col("gap") >= least), "gaps")
            continue
        kept = gaps.where(F.col("gap") < own[0]) if gaps is not None else None
        n, least_own = sum(counts[x] for x in own), own[0]
        while n and gaps is not None and not gaps.where(F.col("gap") >= least_own).isEmpty():
            placed, waiting, rest = _round(waiting, gaps.where(F.col("gap") >= least_own), capacity)
            out += placed
            waiting, rest = stored(waiting, "waiting"), stored(rest.where(F.col("gap") >= least), "gaps")
            n, least_own = waiting.agg(F.count("length"), F.min("length")).first()
            small = F.col("gap") < (least_own or capacity)
            kept = rest.where(small) if kept is None else kept.unionAll(rest.where(small))
            gaps = rest.where(~small)
        if n:
            placed, opened = _opened(waiting, step, capacity)
            out.append(placed)
            gaps = opened if gaps is None else gaps.unionAll(opened)
        gaps = gaps if kept is None else gaps.unionAll(kept)
        gaps = stored(gaps.where(F.col("gap") >= least), "gaps")
    if not out:
        return items.select("row", F.col("row").alias("sequence_id"), F.lit(0).alias("offset"))
    return reduce(DataFrame.unionAll, out)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces with a ``length``) with sequence_id and offset, which replace columns of these names."""
    rows = stored(cut.drop("sequence_id", "offset", "_row").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    places = pack(rows.select(F.col("_row").alias("row"), "length"), capacity).withColumnRenamed("row", "_row")
    return rows.join(places.select("_row", "sequence_id", F.col("offset").cast("long").alias("offset")), "_row").drop("_row")
