"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Two sets can only reach the threshold if their prefixes under one global order share a token. If the prefix of
a document grows by k - 1 tokens, k shared tokens can be asked for. Each document takes the k that its
estimated costs favour: the lengths of the lists its prefix would read, and the comparisons left over. A pair
is compared exactly if it shares at least the smaller k of the two.

The global order puts shingles of frequent counters last, so that common passages stay out of prefixes.

Groups of copies are not expanded into pairs. Documents of equal sets are one node. Then every document is
compared exactly with the pivot of each of a few min-hash buckets, its most central member, which joins the large
groups with a number of comparisons in proportion to the documents; the prefix join has to find only links between
different components. Two documents around one pivot that share too little of the group's core (the pivot's shingles
and others that are common there) can only link through what is beside it: such pairs are sought by these few shingles alone.
Before texts are compared, a bound on what two sets can share after their prefixes leaves out most candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.common import small_side, stored, text_slices
from fathomry.llm.components import components
from fathomry.session import row_count

WORDS = 5
#: Similarity of 3 / 4.
THRESHOLD = (3, 4)
#: The longest prefix asks for so many shared tokens.
MOST_MATCHES = 8
#: Min-hash bins of a document's signature, those that open buckets, and the estimate below which a bucket's pair is left to the prefix join.
BINS, BUCKET_BINS, PROMISING = 32, 8, 0.35
#: Frequency counters: one for so many bytes of text, but at most 16 M (16 MB broadcast). Beyond, only the order gets coarser.
BYTES_PER_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 256, 1 << 16, 1 << 24
_PARTS = 16
#: A shingle that more documents around a pivot have belongs to the group's core.
COMMON = 64


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin and end. Words stand between the six ASCII spaces; A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    full = np.fromiter(map(len, names), np.int64, len(names))[at] > 0  # spaces at an end leave an empty word
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[at]
    return h[full], np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()]


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` words in a row."""
    last = max(0, len(h) - size + 1) if size else 0
    out = np.full(last, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + last]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; of fewer words, the one of them all; of none, none."""
    for part in text_slices(texts):
        h, offsets = word_hashes(part)
        rows = _mixed(h, size)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield np.unique(rows[a : b - size + 1] if b - a >= size else _mixed(h[a:b], b - a))


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.LargeListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])).cast(pa.list_(pa.int64()))


def _signature(s: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin by the leading bits, -1 for an empty bin."""
    edges = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(59))
    ends = np.append(edges[1:], len(s))
    out = np.full(BINS, -1, np.int64)
    full = edges < ends
    out[full] = (s[edges[full]] >> np.uint64(20)).astype(np.int64)
    return out


def _profiles(docs: DataFrame, size: int, counters: int) -> DataFrame:
    """For each document its set's size, a digest of the set and its signature; besides, each task's shingle counts (255: that or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint8)
        names = ["doc_id", "n", "digest", "mins", "part", "counts"]

        def rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            at, more = np.unique((np.concatenate(sets) % np.uint64(counters)).astype(np.uint32), return_counts=True)
            counts[at] = np.minimum(counts[at] + more, 255)
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _list_column([_signature(s) for s in sets])]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)

        for batch in batches:
            sets, held, done = [], 0, 0
            for s in shingle_sets(batch.column("text"), size):
                sets.append(s)
                held += len(s)
                if held >= 1 << 19:
                    yield rows(batch.column("doc_id").slice(done, len(sets)), sets)
                    sets, held, done = [], 0, done + len(sets)
            if sets:
                yield rows(batch.column("doc_id").slice(done), sets)
        one = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        for k, part in enumerate(np.split(counts, _PARTS)):
            yield pa.RecordBatch.from_arrays([*one, pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, mins array<long>, part int, counts binary")


def _classes(profiles: DataFrame, counters: int) -> np.ndarray:
    """A frequency class for each counter: 0 where it isn't above the background, else the logarithm of its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(part, np.zeros(counters // _PARTS, np.int64))
                own += np.frombuffer(counts, np.uint8)
        for part, own in sums.items():
            level = np.floor(np.log2(np.maximum(own, 1))).astype(np.uint8)
            level[own <= 4 * own.mean() + 16] = 0
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "level"])

    counted = profiles.where("part is not null").select("part", "counts").repartition(_PARTS, "part")
    parts = counted.mapInArrow(run, "part int, level binary").toPandas().sort_values("part")
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in parts["level"])])


def ordered_prefix(s: np.ndarray, level: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, int, int]:
    """The tokens of the probing prefix in the global order, the length of the indexing prefix, and the matches asked for."""
    p, q = threshold
    n = len(s)
    own = level[(s % np.uint64(len(level))).astype(np.int64)]
    probe, index = n - -(-p * n // q), n - -(-2 * p * n // (p + q))
    if not own.any():
        return s[: probe + 1], index + 1, 1
    order = np.argsort(own, kind="stable")
    s, own = s[order], own[order]
    k = np.arange(1, max(1, min(MOST_MATCHES, -(-p * n // q))) + 1)
    lists = np.cumsum(np.where(own > 0, 2.0**own, 0))[probe + k - 1]
    k = int(k[np.argmin(lists + lists / k * n)])
    return s[: probe + k], index + k, k


def _ends(own: np.ndarray, level: np.ndarray, at: int) -> int:
    """Where the prefix of the first ``at`` tokens ends in the global order, to 56 bits of the token's hash."""
    token = own[at - 1]
    return (int(level[int(token % np.uint64(len(level)))]) << 56) | (int(token) >> 8)


def _prefixes(reps: DataFrame, level, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Prefixes of documents (doc_id, text and others): these others, n, k, index_n, probe_end, index_end, tokens."""
    others = [c for c in reps.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, tokens = [], [], []
            for k, s in enumerate(shingle_sets(batch.column("text"), size)):
                if len(s):
                    own, index, matches = ordered_prefix(s, level.value, threshold)
                    at.append(k)
                    rows.append((len(s), matches, index, _ends(own, level.value, len(own)), _ends(own, level.value, index)))
                    tokens.append(own)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            made = [pa.array(c, kind) for c, kind in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(others).take(pa.array(at, pa.int64())).columns, *made, _list_column(tokens)], names=[*others, "n", "k", "index_n", "probe_end", "index_end", "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields if f.name != "text")
    return reps.select(*others, "text").mapInArrow(run, f"{kinds}, n long, k int, index_n int, probe_end long, index_end long, tokens array<long>")


def _enough(pairs: DataFrame, docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u the larger set, v, c shared prefix tokens) that can still reach the threshold, without their texts.

    Of two prefixes, the one that ends first in the global order has met all that both sets share up to there; what
    follows it is all that may be added. Where the ends can't be told apart, either bound may hold.
    """
    p, q = threshold
    info = small_side(docs).select("doc_id", "n", "k", F.size("tokens").alias("probe_n"), "index_n", "probe_end", "index_end")
    x = info.select(F.col("doc_id").alias("u"), F.col("n").alias("un"), F.col("k").alias("uk"), "probe_n", "probe_end")
    y = info.select(F.col("doc_id").alias("v"), F.col("n").alias("vn"), F.col("k").alias("vk"), "index_n", "index_end")
    after_u, after_v = f"{p + q} * (c + un - probe_n) >= {p} * (un + vn)", f"{p + q} * (c + vn - index_n) >= {p} * (un + vn)"
    fits = f"c >= least(uk, vk) and (probe_end <= index_end and {after_u} or index_end <= probe_end and {after_v})"
    return pairs.join(x, "u").join(y, "v").where(fits).select("u", "v")


def _sides(pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, u_text) and (v, v_text): the texts of each end of ``pairs`` alone, as few are pivots and texts are what a task holds most of."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("doc_id"), F.lit(c == "u").alias("first")) for c in "uv"])).alias("end")).select("end.*")
    ids = small_side(stored(ends.groupBy("doc_id").agg(F.max("first").alias("u"), F.max(~F.col("first")).alias("v")), "ids"))
    left, right = (docs.select("doc_id", "text").join(ids.where(c).select("doc_id"), "doc_id", "left_semi").toDF(c, f"{c}_text") for c in "uv")
    return left, right


def _compared(pairs: DataFrame, docs: DataFrame, size: int, threshold: tuple[int, int], rest: bool = False) -> DataFrame:
    """The pairs (u, v) of doc_ids whose whole texts reach the threshold, by exact comparison of their sets.

    With ``rest`` all pairs, with both sets' sizes, how many shingles they share, whether they link, and what v lacks of u.
    """
    p, q = threshold
    pairs = stored(pairs, "pairs")
    if not rest and not row_count(pairs, 1):
        return pairs
    left, right = _sides(pairs, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("v").to_numpy(), batch.column("v_text")
            # v stands in many pairs in a row (in one of a repeated doc_id, with other texts between).
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | pc.not_equal(texts.slice(1), texts.slice(0, max(0, len(ids) - 1))).to_numpy(zero_copy_only=False)
            others = shingle_sets(texts.take(pa.array(np.flatnonzero(new))), size)
            found, lacking = [], []
            for s, fresh in zip(shingle_sets(batch.column("u_text"), size), new.tolist(), strict=True):
                own = next(others) if fresh else own
                same = own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s if len(own) else np.zeros(len(s), bool)
                both = int(same.sum())
                found.append((len(s), len(own), both, both > 0 and q * both >= p * (len(s) + len(own) - both)))
                if rest:
                    lacking.append(s[~same])
            cols = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), [pa.int64()] * 3 + [pa.bool_()], strict=True)] if found else [pa.array([], kind) for kind in [pa.int64()] * 3 + [pa.bool_()]]
            if rest:
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *cols, _list_column(lacking)], names=["u", "v", "un", "vn", "both", "linked", "rest"])
            else:
                yield batch.select(["u", "v"]).filter(cols[3])

    # v, a bucket's pivot, occurs in many pairs: joined last, its pairs stand together.
    joined = pairs.join(left, "u").join(right, "v")
    return joined.mapInArrow(run, "u long, v long, un long, vn long, both long, linked boolean, rest array<long>") if rest else joined.mapInArrow(run, "u long, v long").distinct()


def _pivots(nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) of a node and the pivot of one of its buckets that their signatures show to be alike.

    A bucket's pivot is the node with the most company in all its buckets, which an original has rather than its edited
    copies. A node also meets the pivot of its pivot, so that a large group gathers around one.
    """
    buckets = F.explode(F.expr(f"filter(transform(slice(mins, 1, {BUCKET_BINS}), (x, i) -> struct(i, x)), s -> s.x >= 0)"))
    bucketed = nodes.select("node", buckets.alias("bucket"))
    crowds = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("company"), F.min("node").alias("low"), F.max("node").alias("top")).where("low < top")
    crowded = stored(bucketed.join(crowds.select("bucket", "company"), "bucket"), "crowded")
    weights = crowded.groupBy("node").agg(F.sum("company").alias("company"))
    firsts = crowded.drop("company").join(weights, "node").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("v"))).alias("b"))
    firsts = firsts.select("bucket", F.col("b.company").alias("company"), (-F.col("b.v")).alias("v"))
    starred = crowded.drop("company").join(firsts, "bucket").where("node <> v").select(F.col("node").alias("u"), "v", "company").distinct()
    starred = stored(starred, "starred")
    above = starred.groupBy(F.col("u").alias("v")).agg(F.max_by("v", F.struct("company", -F.col("v"))).alias("w"))
    hops = starred.join(above, "v").where("u <> w").select("u", F.col("w").alias("v"))
    starred = starred.select("u", "v").unionAll(hops).distinct()
    mins = nodes.select("node", "mins")
    alike = F.expr("aggregate(zip_with(a, b, (x, y) -> int(x >= 0 and x = y)), 0, (s, x) -> s + x)")
    either = F.expr("aggregate(zip_with(a, b, (x, y) -> int(x >= 0 or y >= 0)), 0, (s, x) -> s + x)")
    return starred.join(mins.toDF("u", "a"), "u").join(mins.toDF("v", "b"), "v").where(alike >= PROMISING * either).select("u", "v")


def _gathered(stars: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents around each pivot, doc_id, pivot, n, over; and what of each is beside the group's core: pivot, token, doc.

    A document's pivot is the one of most company, of those that share a third of its shingles. The core is the pivot's
    set and what more than COMMON documents have besides; ``over`` is what the document shares with the core.
    Documents whose id has several texts (``several``) are left to the general join.
    """
    several = small_side(several)
    rows = stars.where("3 * both >= un").join(several.select(F.col("doc_id").alias("u")), "u", "left_anti").join(several.select(F.col("doc_id").alias("v")), "v", "left_anti")
    company = stored(rows.groupBy("v").agg(F.count(F.lit(1)).alias("company")), "company")
    best = rows.join(small_side(company), "v").groupBy("u").agg(F.max_by(F.struct("v", "vn", "un", "both", "rest"), F.struct("company", "both", -F.col("v"))).alias("b")).select("u", "b.*")
    best = stored(best, "best")
    beside = best.select(F.col("v").alias("pivot"), F.explode("rest").alias("token"), F.col("u").alias("doc"))
    common = stored(beside.groupBy("pivot", "token").count().where(F.col("count") > COMMON).select("pivot", "token"), "common")
    common = small_side(common)
    core = beside.join(common, ["pivot", "token"], "left_semi").groupBy(F.col("doc").alias("u")).agg(F.count(F.lit(1)).alias("more"))
    own = best.join(core, "u", "left").select(F.col("u").alias("doc_id"), F.col("v").alias("pivot"), F.col("un").alias("n"), F.expr("both + coalesce(more, 0)").alias("over"))
    alone = best.groupBy("v").agg(F.min("vn").alias("n")).join(best.select(F.col("u").alias("v")), "v", "left_anti")
    own = own.unionByName(alone.select(F.col("v").alias("doc_id"), F.col("v").alias("pivot"), "n", F.col("n").alias("over")))
    return stored(own, "around"), stored(beside.join(common, ["pivot", "token"], "left_anti"), "beside")


def _placed(around: DataFrame, first: DataFrame) -> DataFrame:
    """``around`` with each document's component, and the component of its pivot (``main``), where a group holds several components.

    It is stored, as its readers use it more than once.
    """
    rows = around.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    main = rows.select(F.col("doc_id").alias("pivot"), F.col("component").alias("main"))
    rows = stored(rows.join(main, "pivot"), "placed")
    split = rows.where("component <> main").select("pivot").distinct()
    return stored(rows.join(split, "pivot", "left_semi"), "split")


def _central(placed: DataFrame) -> DataFrame:
    """The pairs (u, v) of each document that isn't in its pivot's component and the group's document, besides the pivot, that is nearest to the core."""
    nearest = placed.where("doc_id <> pivot").groupBy("pivot").agg(F.min_by("doc_id", F.struct(F.expr("n - 2 * over"), "doc_id")).alias("v"))
    return placed.where("component <> main").join(nearest, "pivot").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")


def _inner(placed: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, pivot, component, n, over, and ``inner``: whether what a document of another component shares within the core may be enough."""
    p, q = threshold
    rows = placed.withColumn("cap", F.expr(f"{p + q} * over div {p} - n")).withColumn("aside", F.expr("component <> main"))
    group = rows.groupBy("pivot").agg(F.max(F.when(F.col("aside"), F.col("cap"))).alias("aside_cap"), F.min(F.when(F.col("aside"), F.col("n"))).alias("aside_n"), F.min("n").alias("least_n"))
    inner = F.expr(f"if(aside, cap >= least_n and {q} * cap >= {p} * n, n <= aside_cap and cap >= aside_n)")
    return rows.join(group, "pivot").select("doc_id", "pivot", "component", "n", "over", inner.alias("inner"))


def _candidates(tables: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """u (the larger set), v, c: how many prefix tokens two documents of different components share.

    So that a large group doesn't meet itself, the documents around a pivot go into the join on the token as one list
    for each (token, pivot); only lists that meet others are read. Pairs around one pivot count here only where what they
    share with it may be enough.
    """
    p, q = threshold
    rows = tables.select(F.col("doc_id").alias("doc"), "component", "pivot", "over", "inner", "n", "index_n", F.posexplode("tokens").alias("pos", "token"))
    rows = rows.withColumn("indexed", F.col("pos") < F.col("index_n")).drop("pos", "index_n")
    kinds = F.when(F.col("inner"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    grouped = stored(rows.where("pivot is not null").withColumn("within", F.explode(kinds)), "grouped")
    lists = stored(grouped.groupBy("token", "within", "pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("docs")), "lists")

    # Single documents and lists: two documents in the one order of sizes, a document and a list, two lists.
    # Most of all rows are here, so they are narrow: size, whether indexed (2) and whether a list (1) are one number.
    heads = rows.where("pivot is null").select("token", "doc", "component", F.expr("n * 4 + if(indexed, 2, 0)").alias("packed"))
    none = F.lit(None).cast("long")
    both = heads.unionAll(lists.where("not within").select("token", "pivot", none, F.expr("docs * 4 + 3")))
    x, y = both.alias("x"), both.where("packed & 2 <> 0").alias("y")
    n, m, many, listed = "shiftright(x.packed, 2)", "shiftright(y.packed, 2)", "x.packed & 1 <> 0", "y.packed & 1 <> 0"
    pair = f"not ({many}) and not ({listed}) and x.component <> y.component and ({n} > {m} or {n} = {m} and x.doc > y.doc) and {q} * {m} >= {p} * {n}"
    met = x.join(y, F.expr(f"x.token = y.token and if({listed}, not ({many}) or x.doc < y.doc, {pair})"))
    own = [F.expr(f"x.{c}").alias(c) for c in ("token", "doc", "component")] + [F.expr(n).alias("n"), F.expr("x.packed & 2 <> 0").alias("indexed"), F.expr(many).alias("many")]
    met = met.select(*own, F.col("y.doc").alias("other"), F.expr(listed).alias("list"), F.expr(m).alias("docs"))
    met = stored(met, "met")
    out = met.where("not list").select(F.col("doc").alias("u"), F.col("other").alias("v"))

    # A document, or each of the shorter of two lists, and each of a list.
    larger = "(x.n > y.n or x.n = y.n and x.doc > y.doc)"
    lone = met.where("list and not many").select("token", "doc", "component", "n", "indexed", "other")
    lists_met = met.where("many").select("token", F.expr("if(n <= docs, doc, other)").alias("pivot"), F.expr("if(n <= docs, other, doc)").alias("other"))
    each = grouped.where("not within")
    x = lone.unionAll(each.join(lists_met, ["token", "pivot"]).select(*lone.columns)).alias("x")
    fits = f"x.token = y.token and x.other = y.pivot and x.component <> y.component and if({larger}, y.indexed and {q} * y.n >= {p} * x.n, x.indexed and {q} * x.n >= {p} * y.n)"
    ends = [F.expr(f"if({larger}, x.doc, y.doc)").alias("u"), F.expr(f"if({larger}, y.doc, x.doc)").alias("v")]
    out = out.unionAll(x.join(each.alias("y"), F.expr(fits)).select(*ends))

    # Two of one list.
    own = grouped.where("within").join(lists.where("within and low < high").select("token", "pivot"), ["token", "pivot"], "left_semi")
    fits = f"x.token = y.token and x.pivot = y.pivot and x.component <> y.component and {larger} and {q} * y.n >= {p} * x.n and {p} * (x.n + y.n) <= {p + q} * least(x.over, y.over)"
    out = out.unionAll(own.alias("x").join(own.where("indexed").alias("y"), F.expr(fits)).select(F.col("x.doc").alias("u"), F.col("y.doc").alias("v")))
    return out.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))


def _beside(around: DataFrame, beside: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) around one pivot that share too little of the core, but with what is beside it may reach the threshold."""
    p, q = threshold
    rows = stored(beside.join(around.select(F.col("doc_id").alias("doc"), "component", "n", "over"), "doc"), "beside")
    lists = rows.groupBy("pivot", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = stored(rows.join(lists.select("pivot", "token"), ["pivot", "token"], "left_semi"), "beside")
    x, y = rows.alias("x"), rows.alias("y")
    fits = f"x.pivot = y.pivot and x.token = y.token and x.component <> y.component and (y.n < x.n or y.n = x.n and y.doc < x.doc) and {q} * y.n >= {p} * x.n and {p} * (x.n + y.n) > {p + q} * least(x.over, y.over)"
    pairs = x.join(y, F.expr(fits)).groupBy(F.col("x.doc").alias("u"), F.col("y.doc").alias("v"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("c"), F.min(F.expr("x.n + y.n")).alias("n"), F.min(F.expr("least(x.over, y.over)")).alias("over"))
    return pairs.where(f"{p + q} * (over + c) >= {p} * n").select("u", "v")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its set's size and component: doc_id, n_shingles, component_id.

    Two documents link if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``threshold``; component_id is the smallest doc_id that links reach. Texts that are null or without words have
    an empty set and link with nothing; with fewer words, the whole sequence is the one shingle. Rows of one
    doc_id are one document as to links. A row whose doc_id is null links with nothing and gets a null component.
    Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (total // BYTES_PER_COUNTER).bit_length()))
    profiles = stored(_profiles(docs, words, counters), "profiles")
    level = spark.sparkContext.broadcast(_classes(profiles, counters))
    rows = profiles.where("part is null").select("doc_id", "n", "digest", "mins")

    # Documents of equal sets are one node, named by their smallest doc_id.
    usable = rows.where("doc_id is not null and n > 0")
    nodes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("mins").alias("mins"), F.count(F.lit(1)).alias("copies")), "nodes")
    copies = usable.join(nodes.where("copies > 1").select("digest", "node"), "digest").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    copies = stored(copies.distinct(), "copies")
    several = stored(usable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id"), "several")

    # Each node against the pivots of its buckets.
    stars = stored(_compared(_pivots(nodes), docs, words, threshold, rest=True), "stars")
    links = stars.where("linked").select("u", "v").unionAll(copies)
    first = stored(components(links), "components")

    # What isn't in the component of its group's pivot, against the most central of the others.
    around, beside = _gathered(stars, several)
    placed = _placed(around, first)
    if row_count(placed, 1):
        more = stored(_compared(_central(placed), docs, words, threshold), "links")
        first = stored(components(first.toDF("u", "v").unionAll(more)), "components")
        placed = _placed(around, first)
    around = stored(_inner(placed, threshold), "around")

    # Prefixes of one document of each node.
    reps = nodes.select(F.col("node").alias("doc_id")).distinct().join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    reps = stored(reps.join(around.select("doc_id", "pivot", "over", "inner"), "doc_id", "left"), "reps")
    tables = stored(_prefixes(docs.join(small_side(reps), "doc_id"), level, words, threshold), "prefixes")
    pairs = _enough(_candidates(tables, threshold), tables, threshold).unionAll(_beside(around, beside, threshold)).distinct()
    more = stored(_compared(pairs, docs, words, threshold), "links")

    final = components(first.toDF("u", "v").unionAll(more)).withColumnRenamed("node", "doc_id")
    return rows.join(final, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(n > 0, coalesce(component, doc_id), doc_id)").alias("component_id"))
