"""Phrase collocation mining: depth-limited count tries per shard, merged by prefix range.

Two passes count hashes in tables of counters: those of words, then those of runs of up to SKETCHED words none of which has
a small counter. A phrase one of whose parts has too small a counter can't be frequent, so that most runs never
enter a trie; a coarser table only lets more through. In a third pass each shard of a task's text grows a trie level by level, in arrays: a node is a phrase, its children
are its continuations. A task's shards are merged and written as sorted (key, count) rows, a key being the path of the
node. Runs of all tasks are merged by ranges of keys; a walk along each merged range adds up equal keys, drops rare
phrases and reads from the path down to a node how often each of its left parts occurs. Right parts follow from
suffix links: the link of a node is its phrase without the first word, whose own right parts are the node's others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.common import byte_kinds, ranked, small_side, split_words, stored, text_slices

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language that are returned, and the share
#: in percent from which a longer candidate replaces one within it.
MOST_WORDS, LEAST_COUNT, FIRST, COVERED = 5, 100, 2_000, 100
#: Runs of up to so many words are counted by hash. Counters: so many increments each, as a share of the least count;
#: at most MOST_COUNTERS. This bounds what is broadcast (a bit a counter, 8 MB) and changes work, never results.
SKETCHED, LOAD, LEAST_COUNTERS, MOST_COUNTERS = 3, 0.3, 1 << 20, 1 << 26
_BLOCK = 1 << 16
#: Words of a shard, and rows of its run after which a task writes what it has merged.
SHARD_WORDS, RUN_ROWS = 1 << 20, 1 << 21
#: Text of a task, where there is enough of it for all cores: each task writes a frequent phrase once.
TASK_BYTES = 1 << 28
UNKNOWN = "und"

_KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_SEP = b"\x00"
_ODD = re.compile(rb"[\x00\x01]")
_SCHEMA = "lang string, key binary, link binary, parent binary, phrase string, depth int, a long, lefts array<long>, part int"


def _escaped(word: bytes) -> bytes:
    """A form without the separator, in the same order."""
    return _ODD.sub(lambda m: b"\x01\x01" if m[0] == b"\x00" else b"\x01\x02", word)


def _plain(word: bytes) -> str:
    return re.sub(b"\x01([\x01\x02])", lambda m: b"\x00" if m[1] == b"\x01" else b"\x01", word).decode()


def _hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` words in a row, from the words' hashes."""
    last = max(0, len(words) - size + 1)
    out = np.full(last, 1 + size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + words[k : k + last]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _coded(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of texts: the words, each one's language as a number among ``langs``, its piece, and its hash within the language."""
    names = langs.dictionary.to_pylist()
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), 7) for x in names), np.uint64, len(names))
    done = 0
    for part in text_slices(texts):
        words, row, piece = split_words(part, _KINDS)
        lang = langs.indices.to_numpy()[done : done + len(part)][row]
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))[coded.indices.to_numpy()]
        yield words, lang, piece, h ^ seeds[lang]
        done += len(part)


def _together(piece: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from here on are of one piece."""
    last = max(0, len(piece) - size + 1)
    return piece[:last] == piece[size - 1 :][:last]


def _may(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the counters of these hashes are large."""
    x = hashes % np.uint64(len(bits) * 8)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counted(rows: DataFrame, counters: int, least: int, lengths: range, bits=None) -> DataFrame:
    """From each task: (lang, n) words by language; (block, counts) compressed counters by blocks, that go up to 255 or ``least``.

    With ``bits``, only runs of words that these may let through are counted.
    """
    kind = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(counters, np.uint32), {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            for _, lang, piece, h in _coded(batch.column("text"), langs):
                for name, k in zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True):
                    sizes[name] = sizes.get(name, 0) + k
                word = _may(bits.value, _hashes(h, 1)) if bits else None
                for size in lengths:
                    fine = _together(piece, size)
                    for k in range(size) if bits else ():
                        fine &= word[k : k + len(fine)]
                    np.add.at(counts, (_hashes(h, size)[fine] % np.uint64(counters)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=["lang", "n", "block", "counts"])
        for k in range(counters // _BLOCK):
            own = np.minimum(counts[k * _BLOCK : (k + 1) * _BLOCK], 255 if least <= 255 else least).astype(kind)
            if own.any():
                sent = pa.compress(own.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([sent], pa.binary())], names=["lang", "n", "block", "counts"])

    return rows.mapInArrow(run, "lang string, n long, block int, counts binary")


def _frequent(counted: DataFrame, counters: int, least: int) -> np.ndarray:
    """A bit for each counter: whether the tasks' counts add up to ``least``."""
    kind = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                own = sums.setdefault(block, np.zeros(_BLOCK, np.int64))
                own += np.frombuffer(pa.decompress(counts.as_buffer(), _BLOCK * np.dtype(kind).itemsize, "zstd"), kind)
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    out = np.zeros((counters // _BLOCK, _BLOCK // 8), np.uint8)
    blocks = counted.where("block is not null").select("block", "counts").repartition("block").mapInArrow(run, "block int, bits binary").toPandas()
    for block, bits in zip(blocks["block"], blocks["bits"], strict=True):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _trie(words: pa.Array, names: list[bytes], lang: np.ndarray, piece: np.ndarray, h: np.ndarray, bits: tuple[np.ndarray, np.ndarray], most_words: int) -> pa.Table:
    """The shard's (key, k): of each phrase that may be frequent, a key of its language and words, and its count."""
    coded = words.dictionary_encode()
    own = pa.array([_escaped(x) for x in coded.dictionary.to_pylist()], pa.binary())
    code, v = coded.indices.to_numpy().astype(np.int64), len(own)
    keys, counts = [], []
    # Level by level: the node that each position's phrase leads to, -1 where it may not be frequent.
    node, parents, before = lang.astype(np.int64), pa.array([_escaped(x) for x in names], pa.binary()), None
    for size in range(1, most_words + 1):
        fine = _together(piece, size)
        if before is not None:
            fine &= (before[:-1] & before[1:])[: len(fine)]
        at = np.flatnonzero(fine)
        at = at[_may(bits[size > 1], _hashes(h, size)[at])] if size <= SKETCHED else at
        if not len(at):
            break
        found, inverse, k = np.unique(node[at] * v + code[at + size - 1], return_inverse=True, return_counts=True)
        parents = pc.binary_join_element_wise(parents.take(pa.array(found // v)), own.take(pa.array(found % v)), _SEP)
        keys.append(parents)
        counts.append(k)
        before, node = np.zeros(len(fine), bool), np.full(len(fine), -1, np.int64)
        before[at], node[at] = True, inverse
    return pa.table({"key": pa.chunked_array(keys, pa.binary()), "k": pa.chunked_array([pa.array(x, pa.int64()) for x in counts], pa.int64())})


def _runs(rows: DataFrame, bits, most_words: int) -> DataFrame:
    """(key, k): the sorted runs of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size, merged = [], {}, 0, pa.table({"key": pa.array([], pa.binary()), "k": pa.array([], pa.int64())})

        def shard() -> pa.Table:
            first, pieces = 0, []
            for _, _, piece, _ in held:
                pieces.append(piece + first)
                first += int(piece[-1]) + 1 if len(piece) else 0
            own = _trie(pa.concat_arrays([x[0] for x in held]), [x.encode() for x in names], *(np.concatenate(x) for x in ([x[1] for x in held], pieces, [x[3] for x in held])), bits.value, most_words)
            both = pa.concat_tables([merged, own]).group_by("key").aggregate([("k", "sum")])
            return both.rename_columns(["key", "k"]).sort_by("key")

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            number = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], np.int64)
            for words, lang, piece, h in _coded(batch.column("text"), langs):
                held.append((words, number[lang], piece, h))
                size += len(words)
                if size >= SHARD_WORDS:
                    merged = shard()
                    held, size = [], 0
                    if len(merged) >= RUN_ROWS:
                        yield from merged.to_batches()
                        merged = merged.slice(0, 0)
        yield from (shard() if held else merged).to_batches()

    return rows.mapInArrow(run, "key binary, k long")


def _walk(least: int):
    """Merges sorted runs: a row for each phrase with ``least`` occurrences, with what its left parts have.

    Where the path to a node began in an earlier range, the parts that lie there are null, and rows with a null ``a`` ask for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, asked = TaskContext.get().partitionId(), [], {}

        def rows(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
            out = []
            for key, a in found:
                while path and not key.startswith(path[-1][0] + _SEP):
                    path.pop()
                names = key.split(_SEP)
                depth = len(names) - 1
                lefts = [None] * (depth - 1 - len(path)) + [x[1] for x in path]
                for k in range(1, depth - len(path)):
                    asked[_SEP.join(names[: k + 1])] = k
                out.append((_plain(names[0]), key, _SEP.join([names[0], *names[2:]]), _SEP.join(names[:-1]), " ".join(map(_plain, names[1:])), depth, a, lefts, part))
                path.append((key, a))
            return _rows(out)

        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, k = batch.column("key"), batch.column("k").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1])
            sums, found = np.add.reduceat(k, starts), []
            if keys[0].as_py() == last:
                sums[0] += total
            elif last is not None and total >= least:
                found.append((last, total))
            fine = np.flatnonzero(sums[:-1] >= least)
            found += zip(keys.take(pa.array(starts[fine])).to_pylist(), sums[fine].tolist(), strict=True)
            last, total = keys[int(starts[-1])].as_py(), int(sums[-1])
            yield rows(found)
        if last is not None and total >= least:
            yield rows([(last, total)])
        yield _rows([(None, key, None, None, None, depth, None, None, part) for key, depth in asked.items()])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "key": pa.binary(), "link": pa.binary(), "parent": pa.binary(), "phrase": pa.string(), "depth": pa.int32(), "a": pa.int64(), "lefts": pa.list_(pa.int64()), "part": pa.int32()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``most_words`` words that occur ``least`` times in a language's texts, and each language's number of words.

    The first table has lang, key, link and parent (the keys of the phrase without its first and last word), phrase, depth, a (occurrences),
    lefts (of its first word, first two words...), rights (without its first word, first two words...). The second has lang, n.
    """
    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    octets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = 1 << int(octets / 6 * (SKETCHED - 1) / (LOAD * least)).bit_length()
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, counters))
    spark = docs.sparkSession.sparkContext
    rows = rows.coalesce(max(spark.defaultParallelism, octets // TASK_BYTES))
    counted = stored(_counted(rows, counters, least, range(1, 2)), "counters")
    words = spark.broadcast(_frequent(counted, counters, least))
    longer = stored(_counted(rows, counters, least, range(2, SKETCHED + 1), words), "counters")
    bits = spark.broadcast((words.value, _frequent(longer, counters, least)))
    runs = stored(_runs(rows, bits, most_words), "runs")
    merged = stored(runs.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_walk(least), _SCHEMA), "merged")

    asked = merged.where("a is null").select("part", "key", "depth").join(merged.where("a is not null").select("key", "a"), "key")
    asked = asked.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("depth", "a"))).alias("before"))
    nodes = merged.where("a is not null").join(small_side(stored(asked, "asked")), "part", "left")
    nodes = nodes.withColumn("lefts", F.transform("lefts", lambda x, i: F.coalesce(x, F.col("before")[i + 1]))).drop("before", "part")
    nodes = stored(nodes, "nodes")

    level = nodes.where("depth = 1").withColumn("rights", F.array().cast("array<long>"))
    levels = [level]
    for depth in range(2, most_words + 1):
        links = level.select(F.col("key").alias("link"), F.concat(F.array("a"), "rights").alias("rights"))
        level = stored(nodes.where(F.col("depth") == depth).join(links, "link"), "level").select(*level.columns)
        levels.append(level)
    sizes = counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionAll, levels), sizes


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, first: int = FIRST, covered: int = COVERED) -> DataFrame:
    """The ``first`` best collocations of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces at ``.,;:!?`` and line breaks, and at spaces and tabs into words; A-Z count as
    lower case. A candidate has 2 to ``most_words`` words and ``least`` occurrences. Its score is the smallest of
    floor(1000 * a * n / (l * r)) over the ways to cut it, ties to the shorter first part. Candidates within a longer one
    that has ``covered`` percent of their occurrences are left out. Ties go to the larger ``a``, then to the first phrase
    in order of bytes. Null and empty texts count for nothing; a null lang is ``und``; repeated rows count each; an
    empty table gives an empty one. Other columns are not read.
    """
    nodes, sizes = frequent_phrases(docs, most_words, least)
    # One more word on either side: what covers a phrase from further out covers these as well.
    longer = nodes.where("depth > 2")
    longer = longer.select("a", F.explode(F.array("link", "parent")).alias("key")).groupBy("key").agg(F.max("a").alias("longest"))
    rows = nodes.where("depth > 1").join(longer, "key", "left").where(f"longest is null or 100 * longest < {covered} * a")
    rows = rows.join(small_side(stored(sizes, "sizes")), "lang")
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    rows = rows.withColumn("top", (wide("a") * F.lit(1000) * wide("n")).cast("decimal(38,0)"))
    cuts = "transform(lefts, (l, i) -> struct(top div (cast(l as decimal(19,0)) * cast(rights[i] as decimal(19,0))) as score, i as k, l as l, rights[i] as r))"
    rows = stored(rows.select("lang", "phrase", "a", "n", F.array_min(F.expr(cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    out = ranked(rows, [F.col("lang").asc(), F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], "lang")
    return out.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: collocations() of ``documents``.
SQL = """
WITH RECURSIVE pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
phrases AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, COUNT(*) AS a
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT range AS size FROM range(1, 6)) WHERE len(w) >= size)
  GROUP BY ALL HAVING COUNT(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases),
longer AS (
  SELECT lang, phrase, MAX(a) AS most FROM (
    SELECT lang, array_to_string(w[2:], ' ') AS phrase, a FROM split WHERE size > 2
    UNION ALL SELECT lang, array_to_string(w[:-2], ' '), a FROM split WHERE size > 2) GROUP BY ALL),
cuts AS (
  SELECT s.lang, s.phrase, s.a, l.a AS l, r.a AS r, n, k, CAST(1000 AS HUGEINT) * s.a * n // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM split WHERE size > 1) s
  JOIN phrases l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[:s.k], ' ')
  JOIN phrases r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.k + 1:], ' ')
  JOIN sizes ON sizes.lang = s.lang),
best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
placed AS (
  SELECT best.*, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR most < a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= 2000
"""
