"""Packing, importance resampling and phrases against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import packing, phrases, resample

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", None), (None, "a b c", "en"), (4, " \n\t ", "en"), (5, "Same text twice", "en"), (5, "Same text twice", "en"), (6, "ü" * 50, None), (7, "x", ""), (8, "\x00 \x01 \x01\x01 \x00\x01 " * 30, "en"), (9, "<|endoftext|> end", "en")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("rank", F.lit(-1)).withColumn("length", F.lit("clash"))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 11 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def cut(spark, rows, **options):
    return packing.pieces(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, **options)


def checked(rows, capacity):
    """Sequences are filled from 0 without gaps and hold at most ``capacity``; how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= capacity
    return len(by)


def test_pieces(spark, tokenizer):
    rows = [*ODD, (10, "some words. " * 900, "en"), (11, " " * 5_000 + "x" + "\n" * 3_000 + "y", "en"), (12, "w" * 40_000, "en")]
    found = defaultdict(list)
    for r in cut(spark, rows, capacity=100, ids=True).collect():
        found[r["doc_id"]].append(r)
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(found[doc_id], key=lambda r: (r["piece"], r["start"]))
        n = sum(r[0] == doc_id for r in rows)
        assert len(own) == n * math.ceil(len(ids) / 100)
        for r in own:
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            assert r["length"] == 100 or r["piece"] == 0
        assert sorted({(r["start"], r["length"]) for r in own})[0][0] == 0 and sum(r["length"] for r in own) == n * len(ids)


@pytest.mark.parametrize("seed,most,n", [(1, 1_024, 3_000), (2, 300, 3_000), (3, 40, 4_000), (4, 1_024, 7)])
def test_packs_nearly_as_well_as_in_sequence(spark, seed, most, n):
    rng = random.Random(seed)
    lengths = [rng.randint(1, most) if rng.random() < 0.7 else most // 3 for _ in range(n)]  # a third has one length
    items = spark.createDataFrame([(k, x) for k, x in enumerate(lengths)], "row long, length int").repartition(5).cache()
    rows = packing.pack(items).join(items, "row").collect()
    assert sorted(r["row"] for r in rows) == list(range(n))
    gaps, best = [], 0
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            best += 1
            gaps.append(1_024 - x)
    assert checked(rows, 1_024) <= best + max(1, best // 50)


def test_packs_odd_rows(spark):
    out = packing.packed(cut(spark, ODD)).collect()
    assert len(out) == len(ODD) and checked(out, 1_024) == 1
    assert packing.packed(cut(spark, ODD).limit(0)).count() == 0


def test_meetings_use_each_gap_once():
    # Pieces of the lowest range meet the gaps left in the ranges above, the nearest first, several in one where they fit.
    found = packing._meetings([(0, 0, None, 2, 500), (1, 3, 400, 1, 90), (2, 9, 30, 0, None)])
    assert found == [(1, 0, 1, 0, 0, 1), (2, 0, 2, 1, 0, 3)]


@pytest.mark.parametrize("step", range(16))
def test_both_libraries_agree(tokenizer, step):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = packing.ByteLevelBpe(f.read(), public_tokenizers.PATTERN)
    assert own.fast is not None
    texts = [f"a{c}1{c}{c} {c}a,{c}" for c in map(chr, range(step * 199, 0x110000, 16 * 199)) if not 0xD800 <= ord(c) < 0xE000]
    assert all(own.encode(x).tolist() == tokenizer.encode(x, add_special_tokens=False).ids for x in texts)


# --- 12 --------------------------------------------------------------------------------------------------------------


def resampled(rows, target, order, buckets, percent, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)]

    own = [features(t) for _, t, _ in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (doc_id, _, _), (n, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("order,percent,least", [(1, 10, 20), (2, 50, 1), (3, 100, 0)])
def test_resampling(spark, order, percent, least):
    rng = random.Random(order)
    rows = [*ODD, *((100 + k, " ".join(rng.choice(["Alpha", "beta-2", "ça", "δ", "x1y", "z"]) for _ in range(rng.randint(0, 60))), "en") for k in range(300))]
    target = ["alpha beta 2", None, "", "δ z z"]
    docs, wanted = docs_of(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(docs, wanted, order, 500, percent, least)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    assert plain(found) == resampled(rows, target, order, 500, percent, least)
    if order == 1:
        drawn = resample.sample(docs, wanted, order=1, buckets=500, percent=percent, least_words=least).collect()
        assert {r["doc_id"] for r in drawn} == {r["doc_id"] for r in found.where("rank is not null").collect()} and all(r["text"] for r in drawn)
        assert resample.resample(docs.limit(0), wanted).count() == 0


def test_radix_selection(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rng = random.Random(3)
    for values in ([(5, 1)] * 4, [(low, high), (high, low), (0, 0), (-1, 5), (-1, -5)], [(rng.choice([-7, 0, 1 << 40]), rng.randint(low, high)) for _ in range(200)]):
        rows = spark.createDataFrame(values, "a long, b long").cache()
        for k in {1, len(values) // 2, len(values)}:
            assert tuple(resample.kth_key(rows, [F.col("a"), F.col("b")], k)) == sorted(values)[k - 1]


# --- 13 --------------------------------------------------------------------------------------------------------------


def mined(rows, most, least, first, covered):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, most + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            cut = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-cut[0], -a, " ".join(p).encode(), own[p[: cut[1]]], own[p[cut[1] :]]))
        out += [(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(rows)[:first])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most,least,covered", [(5, 3, 100), (3, 2, 60), (2, 300, 100)])
def test_phrases(spark, most, least, covered):
    rng = random.Random(most)
    words = ["the", "The", "of", "é", "\x01", "\x00", "a\x01b", "rare word", "x"]
    rows = [*ODD, *((100 + k, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ", ", "\n"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", None, "fr"])) for k in range(120)), (1, "one fixed phrase here. " * 400, "en")]
    docs = docs_of(spark, rows).repartition(4)
    found = phrases.collocations(docs, most, least, 50, covered)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert plain(found) == mined(rows, most, least, 50, covered)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_phrases_by_many_ranges_and_shards(spark, monkeypatch):
    """Paths that begin in another range, shards of few words, and counters so few that they let everything through."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    monkeypatch.setattr(phrases, "LEAST_COUNTERS", 1 << 16)
    monkeypatch.setattr(phrases, "MOST_COUNTERS", 1 << 16)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(40)), "en") for k in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert plain(phrases.collocations(docs_of(spark, rows).repartition(3), 5, 2)) == mined(rows, 5, 2, 2_000, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
