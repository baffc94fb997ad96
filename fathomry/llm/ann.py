"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector; its hash is the
nearest signed axis. A bucket of a table is the axes of several rotations, so that the buckets grow with the vectors; a
query probes the buckets of the axes next nearest as well. How many is fitted: the exact neighbours of a bounded sample of
queries tell how far they lie in the order of probes. Rows and the queries that probe their buckets meet in blocks of
bounded size, in which exact distances pick the k nearest; a query for which too few are found is compared with every vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.common import stored
from fathomry.llm.vectors import BLOCK_ROWS, distinct_vectors, in_blocks, matrix, query_vectors, ranked, usable

#: Every vector is in so many tables.
TABLES = 12

#: So many queries of a length, chosen by hash, are compared with every vector to fit the probes to this recall.
SAMPLE_QUERIES, RECALL = 100, 0.95

#: A table is probed at most so often; where that is too little, its buckets are made of fewer hashes.
MOST_PROBES = 1_024

#: Hashes a bucket is made of at most, however short the vectors.
MOST_HASHES = 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), normalised."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of unit rows, padded to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, as squares of very large or small components leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def probes(x: np.ndarray, table: int, hashes: int, count: int) -> np.ndarray:
    """For each unit row its ``count`` best buckets in a table, the nearest first (fewer, if there are fewer)."""
    buckets, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for h in range(hashes):
        y = rotated(x, 1_000 * table + h)
        signed = np.concatenate([y, -y], axis=1)
        if count == 1:
            buckets = buckets * signed.shape[1] + signed.argmax(axis=1)[:, None]
            continue
        gap = (signed.max(axis=1, keepdims=True) - signed) ** 2
        own = _least(gap, count)
        gap = np.take_along_axis(gap, own, axis=1)
        buckets = (buckets[:, :, None] * signed.shape[1] + own[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        best = _least(loss, count)
        buckets, loss = np.take_along_axis(buckets, best, axis=1), np.take_along_axis(loss, best, axis=1)
    return buckets


def _least(values: np.ndarray, count: int) -> np.ndarray:
    """Where each row's ``count`` least values are, in ascending order."""
    if count >= values.shape[1]:
        return np.argsort(values, axis=1, kind="stable")
    some = np.sort(np.argpartition(values, count - 1, axis=1)[:, :count], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(values, some, axis=1), axis=1, kind="stable"), axis=1)


def _codes(x: np.ndarray, hashes: int, count: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the rows with their buckets in all tables, as one array of table and bucket in one number."""
    axes = 2 << max(0, x.shape[1] - 1).bit_length()
    step = max(1, (1 << 21) // (count * axes))
    for a in range(0, len(x), step):
        part = unit_rows(x[a : a + step])
        yield slice(a, a + step), np.concatenate([probes(part, t, hashes, count) * TABLES + t for t in range(TABLES)], axis=1)


def _parts(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the index that holds a bucket: buckets are dealt evenly."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _by_part(vectors: DataFrame, fits: dict[int, tuple[int, int, int]], probing: bool) -> DataFrame:
    """Rows (vector and others) once for each part of the index they have buckets in, with dim, part and those buckets (codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                hashes, count, parts = fits.get(dim, (1, 1, 1))
                own = batch.filter(pa.array(sizes == dim))
                x = matrix(pa.chunked_array([own.column("vector")]))
                for some, codes in _codes(x, hashes, count if probing else 1):
                    row, code = np.repeat(np.arange(some.start, some.start + len(codes)), codes.shape[1]), codes.ravel()
                    part = _parts(code, parts)
                    order = np.lexsort((code, part, row))
                    row, part, code = row[order], part[order], code[order]
                    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(part) != 0)])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(code))
                    rows = own.take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(first), dim, np.int32)), pa.array(part[first]), lists], names=[*rows.schema.names, "dim", "part", "codes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, dim int, part int, codes array<long>")


def _probes_needed(table: pa.Table) -> pa.Table:
    """dim, hashes and probes for the exact neighbours of the sampled queries of one length."""
    x, v = unit_rows(matrix(table.column("vector"))), unit_rows(matrix(table.column("near")))
    axes = 2 << max(0, x.shape[1] - 1).bit_length()
    hashes = min(MOST_HASHES, max(1, round(np.log(table.column("n")[0].as_py()) / np.log(axes))))
    for hashes in range(hashes, 0, -1):
        step, least = max(1, (1 << 21) // (MOST_PROBES * axes)), []
        for a in range(0, len(x), step):
            at = np.full(len(x[a : a + step]), np.inf)
            for t in range(TABLES):
                hit = probes(x[a : a + step], t, hashes, max(axes, MOST_PROBES) if hashes == 1 else MOST_PROBES) == probes(v[a : a + step], t, hashes, 1)
                at = np.minimum(at, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, np.inf))
            least.append(at)
        need = np.sort(np.concatenate(least))[int(np.ceil(RECALL * len(x))) - 1]
        if need < np.inf:
            break
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "hashes": pa.array([hashes], pa.int32()), "probes": pa.array([int(need)], pa.int32())})


def fitted(groups: DataFrame, asked: DataFrame, k: int = 10) -> dict[int, tuple[int, int, int]]:
    """For each length of vectors: hashes a bucket is made of, probes a table, parts of the index.

    Hashes grow with the logarithm of the number of vectors; probes are as many as reach RECALL on at most SAMPLE_QUERIES
    queries a length. The driver gets one row of four numbers for each length, of which tables have few.
    """
    dim = F.size("vector").alias("dim")
    sizes = groups.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("query_id"), "query_id"))
    sample = stored(asked.select("query_id", "vector", dim).withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_QUERIES).drop("_rank"), "sample")
    found = in_blocks(groups.select("rep", "salt", "vector", "single", dim), sample, ["dim"], _nearest(k), "query_id long, rep long, salt long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "rep", "salt"))
    best = found.withColumn("_place", place).where(F.col("_place") <= k).select("query_id", "rep", "salt")
    near = best.join(groups.select("rep", "salt", F.col("vector").alias("near")), ["rep", "salt"]).join(sample, "query_id").join(sizes, "dim")
    needs = {r["dim"]: (r["hashes"], r["probes"]) for r in near.select("dim", "n", "vector", "near").groupBy("dim").applyInArrow(_probes_needed, "dim int, hashes int, probes int").collect()}
    return {r["dim"]: (*needs.get(r["dim"], (1, 1)), -(-r["n"] * TABLES // BLOCK_ROWS)) for r in sizes.collect()}


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from v; scaled first where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        d = x - v
        out = np.sqrt((d * d).sum(axis=1))
        odd = ~((out > 1e-140) & (out < 1e150))
        if odd.any():
            d = d[odd]
            most = np.abs(d).max(axis=1)
            unit = d / np.where((most > 0) & (most < np.inf), most, 1.0)[:, None]
            out[odd] = np.sqrt((unit * unit).sum(axis=1)) * np.where(most < np.inf, np.where(most > 0, most, 1.0), 1.0)
    return out


def _nearest(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            rep, salt = rows.column("rep").to_numpy(), rows.column("salt").to_numpy()
            order = np.lexsort((salt, rep))
            rep, salt, x, single = rep[order], salt[order], matrix(rows.column("vector"))[order], rows.column("single").to_numpy()[order]
            for q, v in zip(queries.column("query_id").to_pylist(), matrix(queries.column("vector")), strict=True):
                score = distances(x, v)
                score[(rep == q) & single] = np.nan  # last of all
                best = np.argsort(score, kind="stable")[:k]
                out += [(q, int(rep[b]), int(salt[b]), float(score[b])) for b in best if not (rep[b] == q and single[b])]
        q, r, t, s = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "rep": pa.array(r, pa.int64()), "salt": pa.array(t, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _matched(k: int):
    """The k nearest of the rows of a part that share a bucket with a query's probes."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            lists = rows.column("codes").combine_chunks()
            code, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            rep, salt, x, single = rows.column("rep").to_numpy(), rows.column("salt").to_numpy(), matrix(rows.column("vector")), rows.column("single").to_numpy()
            asked = queries.column("codes").combine_chunks()
            looked, ends = asked.flatten().to_numpy(), np.r_[0, np.cumsum(asked.value_lengths().to_numpy())]
            low, high = np.searchsorted(code, looked, "left"), np.searchsorted(code, looked, "right")
            for i, (q, v) in enumerate(zip(queries.column("query_id").to_pylist(), matrix(queries.column("vector")), strict=True)):
                spans = [owner[a:b] for a, b in zip(low[ends[i] : ends[i + 1]], high[ends[i] : ends[i + 1]], strict=True) if a < b]
                if not spans:
                    continue
                at = np.unique(np.concatenate(spans))
                at = at[~((rep[at] == q) & single[at])]
                score = distances(x[at], v)
                best = np.lexsort((salt[at], rep[at], score))[:k]
                out += zip([q] * len(best), rep[at[best]].tolist(), salt[at[best]].tolist(), score[best].tolist(), strict=True)
        q, r, t, s = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "rep": pa.array(r, pa.int64()), "salt": pa.array(t, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries, k: int = 10, parameters: tuple[int, int] | None = None) -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank, vec_id, score (Euclidean distance).

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id. Rows whose vector is null, empty,
    zero or holds null or non-finite components take no part, nor do rows without an id. Every other row is a candidate,
    repeated rows as often as they stand there, but for the rows of the query's own id. An id asks once: of several vectors
    the smallest. A query is compared with vectors of its own length only; ties go to the smaller vec_id. Fewer than k rows come only for fewer candidates. Other columns are not read. ``parameters``:
    hashes a bucket is made of and probes a table; by default they are fitted. An empty table gives an empty result.
    """
    own_kind = vectors.schema["embedding"].dataType.simpleString()
    rows = usable(vectors).where(F.exists("vector", lambda x: x != 0))
    if own_kind == "array<float>":  # half the bytes to shuffle, the same values
        rows = rows.withColumn("vector", F.col("vector").cast(own_kind))
    rows = stored(rows, "vectors")
    groups = stored(distinct_vectors(rows, k), "groups")
    asked = stored(query_vectors(rows, queries), "asked")
    dim = F.size("vector").alias("dim")
    if parameters:
        parts = groups.groupBy(dim).agg(F.count(F.lit(1)).alias("n")).collect()
        fits = {r["dim"]: (*parameters, -(-r["n"] * TABLES // BLOCK_ROWS)) for r in parts}
    else:
        fits = fitted(groups, asked, k)
    schema = "query_id long, rep long, salt long, score double"
    index = _by_part(groups.select("rep", "salt", "vector", "single"), fits, probing=False)
    looked = _by_part(asked, fits, probing=True)
    found = stored(in_blocks(index, looked, ["dim", "part"], _matched(k), schema).distinct(), "found")
    out = stored(ranked(found, groups, k, F.col("score").asc()), "ranked")
    short = asked.join(out.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
    scanned = in_blocks(groups.select("rep", "salt", "vector", "single", dim), short.select("query_id", "vector", dim), ["dim"], _nearest(k), schema)
    rest = ranked(scanned, groups, k, F.col("score").asc())
    return out.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
