"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Documents are encoded once, without a shuffle; only (length, documents) leaves a task. The histogram has one row for
each length that occurs, so it grows with the spread of lengths and not with the documents. Its running sums
are taken within ranges of lengths and over the ranges' totals, and answer totals, quantiles and truncated totals.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.bpe import SPACES
from fathomry.llm.common import small_side, stored

#: Lengths of a range, of which one task sums at most so many.
RANGE = 1_024
#: Runs of white space from here on are cut out before the tokenizer's pattern sees them, which would overflow its stack.
LONG_RUN = 256
_RUNS = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")


class Lengths:
    """Counts tokens with a byte-level rank file (one base64 token and its rank in each line)."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = start = 0
        for run in _RUNS.finditer(text):
            # Pieces never span the start of a run; all of it but a last character before a word is one piece.
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(self.encoding.encode_ordinary(text[start : run.start()]))
            total += len(self.encoding._encode_single_piece(text[run.start() : end].encode()))
            start = end
        return total + len(self.encoding.encode_ordinary(text[start:]))


_loaded: dict[int, Lengths] = {}


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text in ``out`` (long); 0 for null and empty texts.

    A column named ``out`` is replaced. ``path`` is a rank file on the driver; it is sent to the executors (under 2 MB).
    """
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    rest = docs.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema.fields)}, `{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(sent.value)) not in _loaded:
            _loaded.clear()
            _loaded[key] = Lengths(*sent.value)
        count = _loaded[key].count
        for batch in batches:
            found = [count(x.as_py()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, schema)


def histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length; rows with a null length count for nothing."""
    return lengths.where(F.col(n_tokens).isNotNull()).groupBy(F.col(n_tokens).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def sums(hist: DataFrame) -> DataFrame:
    """Running sums of a histogram, one row for each length that occurs.

    n_tokens, docs, docs_longer, tokens_at_most (of documents up to this length), tokens_longer, truncated_tokens (of
    all documents, if each is cut at n_tokens), quantile (share of the documents up to this length). An empty histogram
    gives an empty table.
    """
    part = F.floor(F.col("n_tokens") / RANGE)
    rows = hist.withColumn("part", part).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    totals = stored(rows.groupBy("part").agg(F.sum("docs").alias("part_docs"), F.sum("tokens").alias("part_tokens")), "ranges")
    over, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    base = totals.select("part", *[F.coalesce(F.sum(f"part_{x}").over(over), zero).alias(f"{x}_before") for x in ("docs", "tokens")], *[F.sum(f"part_{x}").over(whole).alias(f"all_{x}") for x in ("docs", "tokens")])
    within = Window.partitionBy("part").orderBy("n_tokens")
    out = rows.join(small_side(stored(base, "bases")), "part")
    at_most = [(F.col(f"{x}_before") + F.sum(x).over(within)).alias(f"{x}_at_most") for x in ("docs", "tokens")]
    out = out.select("n_tokens", "docs", *at_most, "all_docs", "all_tokens")
    longer = F.col("all_docs") - F.col("docs_at_most")
    return out.select(
        "n_tokens", "docs", longer.alias("docs_longer"), "tokens_at_most", (F.col("all_tokens") - F.col("tokens_at_most")).alias("tokens_longer"),
        (F.col("tokens_at_most") + F.col("n_tokens") * longer).alias("truncated_tokens"), (F.col("docs_at_most") / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_longer, truncated_tokens for each context limit, from ``sums``; no row if there are no documents."""
    asked = table.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    # As of the limit: the last length not above it, or the state before the first length.
    each = table.join(F.broadcast(asked), F.col("n_tokens") <= F.col("limit"), "inner").groupBy("limit").agg(F.max_by(F.struct("docs_longer", "tokens_at_most"), "n_tokens").alias("s"))
    documents = table.agg(F.max(F.col("docs_longer") + F.col("docs"))).first()[0]
    longer = F.coalesce("s.docs_longer", F.lit(documents).cast("long"))
    return asked.join(each, "limit", "left").where(longer.isNotNull()).select("limit", longer.alias("docs_longer"), (F.coalesce("s.tokens_at_most", F.lit(0)) + F.col("limit") * longer).alias("truncated_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents doesn't exceed."""
    asked = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return table.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
