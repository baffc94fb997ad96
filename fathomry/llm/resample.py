"""Target-distribution importance resampling: array-scored weights, radix selection, Gumbel top-k.

A document's features are its runs of consecutive words, hashed to buckets. Each task adds up its documents' buckets
in one array, so that only one array a task is shuffled; the sums of the corpus and of the target give each bucket a gain, and
a document's weight is the mean of its gains, read from the array of its buckets. A hash of doc_id adds Gumbel
noise, so the highest scores are a sample without replacement in proportion to the weights' exponentials.

The k-th key of (score, doc_id) is found digit by digit: each pass counts one digit of the rows that share the digits
found so far, and only these counts (4,096 at most) reach the driver. Only rows up to that key are range-sorted and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.llm.common import byte_kinds, ranked, split_words, stored, text_slices

#: Longest feature in words, buckets, share drawn in percent, words that a drawable document has at least.
ORDER, BUCKETS, PERCENT, LEAST_WORDS = 1, 10_000, 10, 20
#: Bits of a digit of the radix selection.
DIGIT = 12
_LOWEST, _MOST = -(1 << 63), (1 << 63) - 1
#: Words are runs of ASCII letters and digits and of all that isn't ASCII.
_KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()))


def _buckets(texts: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and, in order of text and bucket: row, bucket, count of the buckets that its features have."""
    words, row, _ = split_words(texts, _KINDS)
    n_words, found = np.bincount(row, minlength=len(texts)), []
    for size in range(1, order + 1):
        last = max(0, len(words) - size + 1)
        whole = row[:last] == row[size - 1 :][:last]
        runs = words if size == 1 else pc.binary_join_element_wise(*(words.slice(k, last) for k in range(size)), b" ")
        coded = runs.filter(pa.array(whole)).dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
        found.append(row[:last][whole] * buckets + own[coded.indices.to_numpy()])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return n_words, keys // buckets, keys % buckets, counts


def profiles(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_words, n_features, buckets, counts; besides, in rows of their own, each task's ``sums`` by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_features", "buckets", "counts", "sums"]
        sums, kind = np.zeros(buckets, np.int64), pa.list_(pa.int32())
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column("text")):
                n_words, row, bucket, count = _buckets(texts, order, buckets)
                np.add.at(sums, bucket, count)
                n_features = np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)
                ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, count)]
                columns = [batch.column("doc_id").slice(done, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_features), *lists, pa.nulls(len(texts), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(texts)
        nothing = [pa.nulls(1, x) for x in (pa.int64(), pa.int64(), pa.int64(), kind, kind)]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([sums], pa.list_(pa.int64()))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>, sums array<long>")


def _totals(profiled: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; one number a bucket reaches the driver."""
    each = profiled.where("sums is not null").select(F.posexplode("sums").alias("bucket", "k")).where("k > 0").groupBy("bucket").agg(F.sum("k").alias("k")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[each["bucket"]] = each["k"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in the target and in the corpus."""
    s, t, size = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    ratio = (t + 1) * float(int(corpus.sum()) + size) / ((s + 1) * float(int(target.sum()) + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """Of each row of ``docs``: doc_id, row (a number of its own), n_words, n_features, weight, score (all long).

    Weights and gains are integers, floors go down; a text without features has weight 0. The noise depends on
    ``seed`` and doc_id only; a null doc_id counts as an empty one.
    """
    own = stored(profiles(docs, order, buckets), "profiles")
    wanted = profiles(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains(_totals(own, buckets), _totals(wanted, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = batch.column("n_features").to_numpy(), batch.column("buckets").offsets.to_numpy()
            each = sent.value[batch.column("buckets").flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = ends - ends[0] if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "n_words", "n_features"]).columns, pa.array((upto[ends[1:]] - upto[ends[:-1]]) // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = own.where("sums is null").drop("sums").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def _signed(u: int) -> int:
    return u - (1 << 64) if u > _MOST else u


def kth_key(rows: DataFrame, keys: list[Column], k: int) -> list[int]:
    """The k-th smallest tuple of long columns, by radix selection; ``rows`` has k rows at least and is read once for each digit."""
    found = []
    for key in keys:
        flipped = key.bitwiseXOR(F.lit(_LOWEST))  # in unsigned order
        low, high = (int(x) + (1 << 63) for x in rows.agg(F.min(key), F.max(key)).first())
        left = (low ^ high).bit_length()
        prefix = low >> left
        while left:
            digit = min(DIGIT, left)
            left -= digit
            here = F.shiftrightunsigned(flipped, left)
            own = rows.where(F.shiftrightunsigned(here, digit) == _signed(prefix)) if left + digit < 64 else rows
            counts = own.groupBy(here.bitwiseAND(F.lit((1 << digit) - 1)).alias("digit")).count().toPandas().sort_values("digit")
            upto = counts["count"].cumsum().to_numpy()
            at = int(np.searchsorted(upto, k))
            k -= int(upto[at - 1]) if at else 0
            prefix = prefix << digit | int(counts["digit"].iloc[at])
        found.append(prefix - (1 << 63))
        rows = rows.where(key == F.lit(found[-1]))
    return found


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = "2024") -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank (all long), drawn towards ``target`` (text).

    Of the rows with at least ``least_words`` words, floor(percent / 100) of them are drawn: the highest scores, ties
    to the smaller doc_id, a null one last. They have ranks 1, 2, 3... in that order, all others a null rank. Repeated
    rows count each; of rows equal in score and doc_id, those of more features come first. Null and empty texts have no features,
    weight 0 and no rank. An empty table gives an empty one; an empty target has no counts. Other columns are not read.
    """
    rows = stored(scored(docs, target, order, buckets, seed), "scored")
    able = F.col("n_words") >= least_words
    k = percent * rows.where(able).count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(_MOST))]
    first, second = kth_key(rows.where(able), keys, k)
    ahead = able & ((keys[0] < first) | (keys[0] == first) & (keys[1] <= F.lit(second)))
    # Beyond k are only rows of the k-th key itself.
    drawn = ranked(rows.where(ahead), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("row").asc()])
    drawn = drawn.select(*names, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.unionAll(rows.where(~ahead).select(*names, F.lit(None).cast("long").alias("rank")))


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves: the columns of ``docs``, and ``rank``, which replaces a column of that name.

    Of rows of one doc_id with different texts any may stand for a drawn one, as they share their noise; one row
    is returned for each rank.
    """
    ranks = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_doc"), "rank")
    rows = docs.drop("rank").dropDuplicates(["doc_id"])
    return rows.join(ranks, rows["doc_id"].eqNullSafe(F.col("_doc"))).select(*rows.columns, "rank")


#: resample() of ``documents`` towards ``benchmark``; the first two tables compute CRC-32.
SQL = """
WITH RECURSIVE steps AS (
  SELECT b, b AS v, 0 AS i FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8),
texts AS (SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
split AS (
  SELECT kind, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words FROM texts),
each AS (SELECT kind, doc_id, unnest(words) AS word FROM split),
named AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(octet_length(encode(word)) AS BIGINT)),
         lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM each), crc),
found AS (SELECT kind, doc_id, bucket FROM each JOIN named USING (word)),
counts AS (SELECT bucket, COUNT(*) FILTER (kind = 'd') AS s, COUNT(*) FILTER (kind = 't') AS t FROM found GROUP BY bucket),
totals AS (SELECT COUNT(*) FILTER (kind = 'd') AS sa, COUNT(*) FILTER (kind = 't') AS ta FROM found),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sa + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(ta + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts, totals),
sums AS (SELECT doc_id, CAST(SUM(gain) AS BIGINT) AS total, COUNT(*) AS n FROM found JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_features, CAST(COALESCE(floor(CAST(total AS DOUBLE) / n), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM weighed),
able AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored s LEFT JOIN able USING (doc_id)
"""
