"""Line deduplication by a log-template tree of fixed depth.

Lines are parsed by token count and leading tokens; fields that vary are generalised, and templates that recur
across documents are dropped. Tokens that hold a digit are variable from the start. Distinct parsed lines are
counted over distinct texts first, so that very common lines don't meet in one task; only leaves whose lines occur in
enough texts are clustered by similarity, each a group of bounded size: a leaf that holds too many lines is
dealt out to several tasks, whose templates are merged until no two of the leaf are similar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm import jaccard
from fathomry.llm.common import BROADCAST_ROWS, small_side, stored
from fathomry.llm.components import components

#: So many digests of recurring lines may be broadcast: 32 MB.
BROADCAST_LINES = 4_000_000
#: Leading tokens of a leaf.
DEPTH = 3
#: A task clusters so many distinct lines at once (twice as many when two chunks of a large leaf meet).
LEAF_LINES = 1_024
#: Templates of fewer tokens say too little.
LEAST_TOKENS = 3
#: A template recurs if it occurs in so many different texts.
LEAST_TEXTS = 5
#: A line of so many tokens is a passage, which nobody writes twice: it recurs if it occurs in so many different texts.
LONG_TOKENS, LONG_TEXTS = 50, 2
#: Lines of which so large a share of fields agrees belong to one template.
SIMILARITY = 0.7
#: Positions that are compared; a longer line's tokens are compared in as many equal stretches.
FIELDS = 64

#: The end of a token from its first digit; its replacement leaves "0" in these tokens alone.
_DIGITS = re.compile(r"\d\S*")
_digest = xxhash.xxh3_64_intdigest
_SIGN = 1 << 63
#: A template's position in which its lines differ.
_WILD = -_SIGN
_CHUNK = "line long, leaf long, texts long, fields array<long>, key long, size long, chunks long, chunk long"


def _key(tokens: str) -> int:
    """A signed 64-bit digest."""
    return (_digest(tokens.encode("utf-8", "replace")) ^ _SIGN) - _SIGN


def parsed_lines(text: str | None) -> list[tuple[int, list[str]]]:
    """The digest and the tokens of each line; lines of too few tokens have the digest 0.

    The digits of the whole text are marked in one go, in time linear in its length; a token never spans a line.
    """
    out = []
    for line in _DIGITS.sub("0", text or "").split("\n"):
        tokens = line.split()
        if "0" in line:
            tokens = ["<*>" if token[-1] == "0" else token for token in tokens]
        out.append((_key(" ".join(tokens)) if len(tokens) >= LEAST_TOKENS else 0, tokens))
    return out


def _leaf(tokens: list[str]) -> int:
    return _key(f"{len(tokens)} {' '.join(tokens[:DEPTH])}")


def fields(tokens: list[str]) -> list[int]:
    """Digests of the line's positions; of stretches of tokens, if there are more than FIELDS."""
    n = len(tokens)
    if n <= FIELDS:
        return [_key(x) for x in tokens]
    edges = [k * n // FIELDS for k in range(FIELDS + 1)]
    return [_key(" ".join(tokens[a:b])) for a, b in zip(edges, edges[1:])]


def _lines(texts: DataFrame) -> DataFrame:
    """(text_key, line, leaf, size: tokens) once for each different line of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, leaves, tokens_of, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                own: dict[int, list[str]] = {}
                for key, tokens in parsed_lines(text):
                    if key:
                        own.setdefault(key, tokens)
                lines += own.keys()
                leaves += map(_leaf, own.values())
                tokens_of += map(len, own.values())
                sizes.append(len(own))
            keys = batch.column("text_key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(lines, pa.int64()), pa.array(leaves, pa.int64()), pa.array(tokens_of, pa.int32())], names=["text_key", "line", "leaf", "size"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key long, line long, leaf long, size int")


def _shapes(texts: DataFrame) -> DataFrame:
    """line and fields of the ``wanted`` lines of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                wanted = set(wanted)
                for key, tokens in parsed_lines(text):
                    if key in wanted:
                        wanted.remove(key)
                        rows.append((key, fields(tokens)))
            cols = list(zip(*rows, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64()))], names=["line", "fields"])

    return texts.select("text", "wanted").mapInArrow(run, "line long, fields array<long>")


def generalised(table: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The template number of each row of field digests, in order, and the templates; fields in which a template's lines differ are _WILD and don't count as equal.

    A line (or template) joins the most similar template, the first of equal ones, and generalises it. As templates
    only lose fields, no two of those that come out are similar, nor will be.
    """
    n, width = table.shape
    templates, fixed = np.empty_like(table), np.ones((n, width), bool)
    out, count = np.empty(n, np.int64), 0
    for k, row in enumerate(table):
        if count:
            equal = ((templates[:count] == row) & fixed[:count]).sum(axis=1)
            best = int(equal.argmax())
            if equal[best] >= similarity * width:
                out[k] = best
                fixed[best] &= templates[best] == row
                continue
        templates[count] = row
        fixed[count] = row != _WILD
        out[k] = count
        count += 1
    return out, np.where(fixed[:count], templates[:count], _WILD)


def clusters(table: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The template number of each row of field digests, in order."""
    return generalised(table, similarity)[0]


def _templates(rows: pa.Table) -> pa.Table:
    """Templates of the lines of several whole leaves, the more frequent lines first; each has the digest of its first line."""
    lines, leaves = rows.column("line").to_numpy(), rows.column("leaf").to_numpy()
    column = rows.column("fields").combine_chunks()
    values, starts = column.values.to_numpy(), column.offsets.to_numpy()
    order = np.lexsort((lines, -rows.column("texts").to_numpy(), leaves))
    lines, leaves = lines[order], leaves[order]
    edges = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(order)]
    out = np.empty_like(lines)
    for a, b in zip(edges, edges[1:]):
        own = order[a:b]
        width = starts[own[0] + 1] - starts[own[0]]
        found = clusters(values[starts[own][:, None] + np.arange(width)])
        out[a:b] = lines[a:b][np.unique(found, return_index=True)[1]][found]
    return pa.table({"line": lines, "template": out})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk's lines or templates and what they join (``into``, itself for those that stay, with generalised fields)."""
    pdf = pdf.sort_values(["texts", "line"], ascending=[False, True])
    found, made = generalised(np.stack(pdf["fields"].to_numpy()))
    first = np.unique(found, return_index=True)[1]
    stays = np.zeros(len(pdf), bool)
    stays[first] = True
    rows = [made[k] if one else None for k, one in zip(found, stays, strict=True)]
    return pdf.drop(columns="group").assign(fields=rows, into=pdf["line"].to_numpy()[first][found])


def _block_key(block: int):
    """A digest of the block-th stretch of a line's fields, null if the line has fewer stretches or a field of it varies.

    The positions after the leaf's own are cut into one stretch more than similar lines may differ in, so that any two
    similar ones agree in a whole stretch.
    """

    @F.pandas_udf("long")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            n = len(row)
            same = DEPTH if n < FIELDS else 0  # the stretches of a long line don't end where the leaf's tokens do
            blocks = min(n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1, n - same)
            own = row[same + block * (n - same) // blocks : same + (block + 1) * (n - same) // blocks] if block < blocks else row[:0]
            out.append(_digest(np.asarray(own, np.int64).tobytes()) - _SIGN if len(own) and _WILD not in own else None)
        return pd.Series(out, dtype="Int64")

    return run(F.col("fields"))


def _dealt(live: DataFrame, salt: int) -> DataFrame:
    """``live`` with the size of a row's group (leaf, key), the group's number of chunks, a power of two, and the row's chunk."""
    sizes = live.groupBy("leaf", "key").count()
    sizes = stored(sizes.select("leaf", "key", F.col("count").alias("size"), F.expr(f"cast(pow(2, ceil(log2(greatest(count / {LEAF_LINES}D, 1)))) as long)").alias("chunks")), "sizes")
    out = live.join(small_side(sizes), ["leaf", "key"])
    return stored(out.select("line", "leaf", "texts", "fields", "key", "size", "chunks", F.expr(f"pmod(xxhash64(line, {salt}), chunks)").alias("chunk")), "chunks")


def _met(chunks: DataFrame, links: list[DataFrame], turn: int = 0) -> DataFrame:
    """What stays of ``chunks`` when chunk c of each group has met chunk c xor ``turn``; what joined another goes to ``links``."""
    group = F.xxhash64("leaf", "key", F.expr(f"least(chunk, chunk ^ {turn}L)"))
    rows = chunks.where(f"chunks > {turn}").select("line", "leaf", "texts", "fields", "key", "size", "chunks", "chunk", group.alias("group"))
    out = stored(rows.groupBy("group").applyInPandas(_merge, f"{_CHUNK}, into long"), "merged")
    links.append(out.where("line <> into").select(F.col("line").alias("u"), F.col("into").alias("v")))
    return out.where("line = into").drop("into").unionByName(chunks.where(f"chunks <= {turn}"))


def _merged_leaves(rows: DataFrame) -> DataFrame:
    """Templates of leaves with more than LEAF_LINES lines: line, template; lines that are like no other are left out.

    A leaf is dealt out to chunks, and their templates are dealt out anew as long as they get much fewer. In leaves
    that stay large, all that agree in a stretch of fields meet; if those are many, each of their chunks meets each other.
    """
    links: list[DataFrame] = []
    stuck, salt = [], 0
    live = rows.select("line", "leaf", "texts", "fields", F.lit(1 << 62).alias("key"))  # the key: the leaf's size before
    while True:
        chunks = _dealt(live, salt)
        stuck.append(chunks.where("chunks > 1 and size > 0.8D * key").select("line", "leaf", "texts", "fields"))
        chunks = chunks.where("chunks = 1 or size <= 0.8D * key")
        if not chunks.limit(1).count():
            break
        left = _met(chunks, links).where("chunks > 1")  # a leaf in one chunk is done
        live, salt = left.select("line", "leaf", "texts", "fields", F.col("size").alias("key")), salt + 1
    live = stored(reduce(DataFrame.unionAll, stuck), "stuck")
    widest = live.agg(F.max(F.size("fields"))).first()[0] or 0
    for block in range(int(widest * (1 - SIMILARITY)) + 2 if widest else 0):
        keyed = stored(live.withColumn("key", _block_key(block)), "keyed")
        chunks = _dealt(keyed.where("key is not null"), 0)
        for turn in range(chunks.agg(F.max("chunks")).first()[0] or 0):
            chunks = _met(chunks, links, turn)
        live = keyed.where("key is null").unionByName(chunks.select(*keyed.columns)).drop("key")
    return components(reduce(DataFrame.unionAll, links)).withColumnRenamed("node", "line").withColumnRenamed("component", "template")


def _often(counted: DataFrame, least_texts: int, long_texts: int) -> DataFrame:
    """The rows of ``counted`` (long, count) whose count is enough."""
    return counted.where(F.col("count") >= F.when(F.col("long"), long_texts).otherwise(least_texts)).drop("count")


def recurring_lines(texts: DataFrame, lines: DataFrame, least_texts: int = LEAST_TEXTS, long_texts: int = LONG_TEXTS) -> DataFrame:
    """The digests of lines that occur, or whose template does, in enough of the texts: line, long, template (null for a line alone).

    ``texts`` has text_key and text, ``lines`` is what ``_lines`` makes of them, once for each text_key and line.
    """
    lines = lines.withColumn("long", F.col("size") >= LONG_TOKENS)
    counts = stored(lines.groupBy("line", "leaf", "long").agg(F.count(F.lit(1)).alias("count"), F.min("text_key").alias("text_key")), "line-counts")
    often = _often(counts, least_texts, long_texts).select("line", "long", F.lit(None).cast("long").alias("template"))

    # Leaves in which several lines may form a template. Their shapes come from one text each.
    leaves = counts.groupBy("leaf", "long").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("lines"))
    leaves = stored(_often(leaves, least_texts, long_texts).where("lines > 1").select("leaf"), "leaves")
    some = stored(counts.withColumnRenamed("count", "texts").join(small_side(leaves), "leaf", "left_semi"), "candidates")
    wanted = stored(some.groupBy("text_key").agg(F.collect_list("line").alias("wanted")), "wanted")
    shapes = _shapes(texts.join(small_side(wanted, BROADCAST_ROWS // 10), "text_key")).groupBy("line").agg(F.first("fields").alias("fields"))
    rows = stored(some.select("line", "leaf", "texts", "long").join(shapes, "line"), "shapes")

    large = stored(rows.groupBy("leaf").count().where(F.col("count") > LEAF_LINES).select("leaf"), "large")
    grouped = rows.join(small_side(large), "leaf", "left_anti").drop("long")
    tasks = rows.count() // LEAF_LINES + 1  # small leaves share a group of about LEAF_LINES lines
    found = stored(grouped.groupBy(F.expr(f"pmod(hash(leaf), {tasks})")).applyInArrow(_templates, "line long, template long"), "templates")
    if large.limit(1).count():
        found = found.unionByName(stored(_merged_leaves(rows.join(small_side(large), "leaf", "left_semi")), "templates"))

    # The different texts of a template's several lines.
    several = found.groupBy("template").count().where("count > 1").drop("count")
    members = stored(found.join(several, "template").join(rows.select("line", "long"), "line").select("line", "long", "template"), "members")
    spread = lines.select("text_key", "line").join(small_side(members), "line").select("template", "long", "text_key").distinct()
    wide = stored(_often(spread.groupBy("template", "long").count(), least_texts, long_texts).select("template"), "wide")
    more = members.join(small_side(wide), "template", "left_semi").select("line", "long", "template")
    return often.unionAll(more)


def _apart(texts: DataFrame, lines: DataFrame, hits: DataFrame, least_texts: int, long_texts: int) -> DataFrame:
    """The lines that still recur when a group of near duplicates counts as one text: line.

    ``hits`` has text_key, line, size, long and template. Only texts of which recurring lines are at least half can be copies
    as a whole; others count each.
    """
    sizes = lines.groupBy("text_key").agg(F.sum("size").alias("all"))
    whole = hits.groupBy("text_key").agg(F.sum("size").alias("own")).join(sizes, "text_key").where("2 * own >= all").select("text_key")
    own = texts.join(small_side(stored(whole, "whole-texts")), "text_key", "left_semi")
    own = stored(own.groupBy(F.col("text_key").alias("doc_id")).agg(F.first("text").alias("text")), "hit-texts")
    groups = stored(jaccard.near_duplicates(own).select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("near")), "near")
    counted = hits.join(small_side(groups), "text_key", "left").withColumn("near", F.coalesce("near", "text_key"))
    counted = stored(counted.select("line", "long", "template", "near").distinct(), "counted")
    often = _often(counted.where("template is null").groupBy("line", "long").count(), least_texts, long_texts).select("line")
    wide = counted.where("template is not null").select("template", "long", "near").distinct().groupBy("template", "long").count()
    wide = stored(_often(wide, least_texts, long_texts).select("template"), "wide")
    more = counted.select("line", "template").distinct().join(small_side(wide), "template", "left_semi").select("line")
    return often.unionAll(more).distinct()


def _without(recurring=None):
    """A function of texts (null: untouched) and of the lines found in each or, with ``recurring`` (a broadcast array of sorted digests), of texts alone.

    Texts that lose no line come back as null, so that they don't cross to the JVM again.
    """

    def cut(text: str | None, gone: list[bool]) -> tuple[str | None, int]:
        return ("\n".join(p for p, g in zip(text.split("\n"), gone, strict=True) if not g), sum(gone)) if any(gone) else (None, 0)

    def keys_of(text: str | None) -> list[int]:
        return [] if text is None else [key for key, _ in parsed_lines(text)]

    @F.pandas_udf("text string, lines_dropped long")
    def by_lists(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = [cut(x, [key in own for key in keys_of(x)]) for x, own in ((x, () if own is None else set(own)) for x, own in zip(text, found, strict=True))]
        return pd.DataFrame(out, columns=["text", "lines_dropped"])

    @F.pandas_udf("text string, lines_dropped long")
    def by_digests(text: pd.Series) -> pd.DataFrame:
        keys = [keys_of(x) for x in text]
        ends = np.cumsum([0, *map(len, keys)])
        own = np.fromiter((key for row in keys for key in row), np.int64, ends[-1])
        known = recurring.value
        gone = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
        out = [cut(x, gone[a:b].tolist()) for x, a, b in zip(text, ends, ends[1:], strict=False)]
        return pd.DataFrame(out, columns=["text", "lines_dropped"])

    return by_digests if recurring else by_lists


def drop_recurring(docs: DataFrame, least_texts: int = LEAST_TEXTS, long_texts: int = LONG_TEXTS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` (text and any other columns) without the lines whose template recurs, and with ``lines_dropped`` (long).

    A template recurs if it occurs in at least ``least_texts`` different texts, one of LONG_TOKENS tokens or more in
    ``long_texts``; exact copies of a text count as one,
    and so do near duplicates (word 5-grams with a Jaccard similarity of 0.75) of which recurring lines are at least
    half; these are left to document deduplication.
    Templates of fewer than LEAST_TOKENS tokens say too little and stay. Lines
    end at a newline; other lines, blank ones included, stay as they are, in order. Null and empty texts stay,
    repeated rows are treated alike, and a column lines_dropped is replaced. No row goes. An empty table gives an empty result.
    The digests of up to ``broadcast_lines`` recurring lines are broadcast; more are joined by text, with the same results.
    """
    docs = docs.drop("lines_dropped")
    texts = docs.where("text <> ''").select(F.xxhash64("text").alias("text_key"), "text")
    lines = stored(_lines(texts).distinct(), "lines")
    recurring = stored(recurring_lines(texts, lines, least_texts, long_texts), "recurring")
    hits = stored(lines.select("text_key", "line", "size").join(small_side(recurring), "line"), "hits")
    recurring = stored(_apart(texts, lines, hits, least_texts, long_texts), "recurring")
    if recurring.limit(broadcast_lines + 1).count() <= broadcast_lines:
        # The digests go to the texts, so that no text moves.
        digests = np.sort(recurring.toPandas()["line"].to_numpy(np.int64))
        kept = _without(docs.sparkSession.sparkContext.broadcast(digests))(F.col("text"))
        out = docs.withColumn("_kept", kept)
    else:
        hit = lines.join(recurring, "line").groupBy("text_key").agg(F.collect_set("line").alias("_found"))
        hit = stored(hit.withColumnRenamed("text_key", "_text_key"), "hit")
        out = docs.join(small_side(hit, BROADCAST_ROWS // 10), F.xxhash64("text") == F.col("_text_key"), "left")
        out = out.withColumn("_kept", _without()(F.when(F.col("_found").isNotNull(), F.col("text")), F.col("_found")))
    text = F.when(F.col("_kept.lines_dropped") > 0, F.col("_kept.text")).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], F.coalesce("_kept.lines_dropped", F.lit(0)).cast("long").alias("lines_dropped"))
