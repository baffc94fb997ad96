"""Each operator against brute force on small tables, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomry.llm import ann, bpe, chat, jaccard, langid, lengths, mixing, queries, templates, url_lists, vafile
from fathomry.llm.common import small_side, stored
from fathomry.session import row_count

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not DIR.exists(), reason="no tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "x", "ü" * 50, "a b c " * 3000, "same text twice here now", "same text twice here now", " \x1c\x85", "5 7 9"]


def odd_docs(spark, schema=DOCS):
    rows = [(None if k == 4 else k, t, "en" if k % 2 else None, None if k % 3 == 0 else "s", len(t or "")) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], schema).withColumn("leaf", F.lit(1)).withColumn("score", F.lit("clash"))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_url_lists(spark):
    at = F.to_timestamp("at")
    entries = [("Bad.example.", "block", "add", "2024-01-01"), ("bad.example", "block", "remove", "2024-02-01"), ("bad.example", "block", "add", "2024-03-01"), ("ok.bad.example/a", "allow", "add", "2024-01-01"), (None, "block", "add", "2024-01-01"), ("/x", "block", "add", "2024-01-01")]
    entries = spark.createDataFrame(entries, "pattern string, action string, change string, at string").withColumn("at", at)
    urls = [("http://bad.example/", "2023-12-31", False), ("http://bad.example/", "2024-01-01", True), ("https://U:p@WWW.BAD.example.:80/q?x#y", "2024-01-15", True), ("http://bad.example", "2024-02-01", False), ("http://bad.example", "2024-03-02", True), ("http://ok.bad.example/a/b", "2024-03-02", False), ("http://ok.bad.example/ab", "2024-03-02", True), ("http://notbad.example/", "2024-01-02", False), ("no url", "2024-01-02", False), (None, "2024-01-02", False), ("http://bad.example", None, False), ("http://bad.example/" + "d/" * 20_000, "2024-01-02", True), ("http://" + "a." * 20_000 + "bad.example", "2024-01-02", True)]
    captures = spark.createDataFrame([*urls, urls[1]], "url string, at string, expected boolean").select("url", at.alias("fetched_at"), "expected", F.lit(1).alias("blocked"), F.lit(2).alias("labels"))
    for limit, hot in ((1_000_000, 500_000), (0, 1)):  # broadcast; by key with salted hot keys
        rows = url_lists.evaluate(captures, entries, limit, hot).collect()
        assert len(rows) == len(urls) + 1 and all(r.blocked == r.expected for r in rows)
    assert url_lists.allowed(captures, entries).count() == sum(not u[2] for u in urls)
    assert url_lists.evaluate(captures, entries.limit(0)).where("blocked").count() == 0 and url_lists.evaluate(captures.limit(0), entries).count() == 0


@here
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DIR.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = queries.QUERIES[name](spark, str(DIR))
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    value = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([value(r[c]) for c in columns]) for r in df.collect()) == sorted(str(list(map(value, r))) for r in found.fetchall())


# --- 2 and 4 ---------------------------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x[300:320] = x[300]  # copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(None, x[0].tolist()), (900, None), (1000, []), (1001, [float("nan")] * 24), (1002, [None] * 24), (1100, [0.0] * 24), (1200, [1.0, 2.0]), (7, x[7].tolist())]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("dim", F.lit("clash"))


def test_nearest(spark):
    x, df = vectors(spark)
    found = defaultdict(list)
    for r in ann.nearest(df, F.expr("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((k for k in range(600) if k != q), key=lambda k: (d[k], k))[:10]
        assert all(math.isclose(s, d[k], abs_tol=1e-12) for k, s in found[q]) and len(found[q]) == 10
        hit += len({k for k, _ in found[q]} & set(best))
    assert hit >= 54 and found.keys() == set(range(0, 600, 100))
    assert found[300][:10] == [(k, 0.0) for k in range(301, 311)]
    assert ann.nearest(df.limit(0), F.expr("vec_id % 100 = 0")).count() == 0


@here
def test_recall_of_the_query(spark):
    rows = spark.read.parquet(str(DIR / "embeddings.parquet")).collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(set)
    for r in queries.QUERIES["op2_nearest_neighbours"](spark, str(DIR)).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        best = [k for k in ids[np.lexsort((ids, d))] if k != q][:10]
        hits, total = hits + len(found[q] & set(best)), total + len(best)
    assert hits >= 0.9 * total


def test_probes_select_few_where_neighbours_are_near(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6_000)] + 0.4 * rng.normal(size=(6_000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.stored(ann.usable(df), "rows")
    groups = ann.distinct_vectors(rows, 10).withColumn("single", F.lit(True))
    asked = ann.query_vectors(rows, F.expr("vec_id % 100 = 0"))
    hashes, count, _ = ann.fitted(ann.stored(groups, "groups"), asked)[32]
    u, q = ann.unit_rows(x), np.arange(0, 6_000, 100)
    seen = np.zeros((len(q), len(x)), bool)
    for t in range(ann.TABLES):
        own, looked = ann.probes(u, t, hashes, 1)[:, 0], ann.probes(u[q], t, hashes, count)
        seen |= np.array([np.isin(own, p) for p in looked])
    nearest = np.argsort(((x[q][:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:11]
    assert np.take_along_axis(seen, nearest, axis=1).mean() >= 0.9 and seen.mean() < 0.06


def test_top_products(spark):
    x, df = vectors(spark)
    y = np.floor(x * 1024).astype(np.int64)
    y = {k: v for k, v in enumerate(y)} | {1100: np.zeros(24, np.int64)}
    candidates = [*y.items(), (7, y[7])]  # the repeated row stands there twice
    found = defaultdict(list)
    for r in vafile.top_products(df, F.expr("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q in (*range(0, 600, 100), 1100):
        assert found[q] == sorted(((k, int(v @ y[q])) for k, v in candidates if k != q), key=lambda t: (-t[1], t[0]))[:10]
    assert vafile.top_products(df.limit(0), F.expr("vec_id % 100 = 0")).count() == 0


def test_searches_count_repeated_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 4)).round(2)
    rows = [(i, base[i % 9].tolist()) for i in (100, 100, 200, 3, 3, 3, 5, 6, 7, 8, 12)]
    rows += [(100, base[2].tolist()), (200, base[2].tolist()), (4, base[1].tolist())] + [(300, base[0].tolist())] * 14 + [(301, base[0].tolist())] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("frame", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    con.sql("create view embeddings as select * from frame")
    wanted = con.execute(vafile.SQL).fetchall()
    found = vafile.top_products(df, F.expr("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert len(wanted) == 30 and sorted(map(tuple, found)) == sorted(wanted)
    near = ann.nearest(df, F.expr("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    for query in (100, 200, 300):
        own = min(v for i, v in rows if i == query)
        best = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in rows if i != query)[:10]
        assert [(r.vec_id, round(r.score, 9)) for r in near if r.query_id == query] == [(i, round(d, 9)) for d, i in best]


def test_starts_and_moves_whatever_the_turns_numbers(spark):
    roles = [["user", "assistant", "user"], ["system", "user", "assistant"], ["user", "assistant"], ["assistant"]]
    fitted = []
    for number in (lambda t: t, lambda t: t + 1, lambda t: 5 * t - 7, lambda t: 10 * t + 1000):
        rows = [(c, number(t), role, f"Line {t}.") for c, own in enumerate(roles) for t, role in enumerate(own)]
        fitted.append(chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for model in fitted[1:]:
        assert np.allclose(model.start, fitted[0].start) and np.allclose(model.move, fitted[0].move)
    chances = dict(zip(fitted[0].roles, np.exp(fitted[0].start), strict=True))
    assert chances["user"] == pytest.approx(2.5 / 5.5) and chances["system"] == pytest.approx(1.5 / 5.5)


def test_searches_keep_large_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (1, [300_000.0, 1.0]), (2, [3.0, -2e6]), (3, [1e200, -1e200]), (4, [1e-200, 2e-200]), (5, [2.0, 2.0]), (5, [7.0, 9.0]), (0, [1.5, 2.0]), (5, [2.0, 2.0]), (6, [-2e6, 4e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.vec_id, r.score) for r in ann.nearest(df, F.expr("vec_id = 0")).orderBy("rank").collect()]
    best = sorted((math.dist((1.0, 2.0), v), k) for k, v in rows if k)
    assert [k for k, _ in found] == [k for _, k in best] and all(math.isclose(s, d) for (_, s), (d, _) in zip(found, best, strict=True))
    assert [r.vec_id for r in ann.nearest(df, F.expr("vec_id = 3")).orderBy("rank").collect()][:2] != [] and ann.nearest(df, F.expr("vec_id = 4")).orderBy("rank").first().score > 0
    fits = df.where("vec_id <> 3")
    exact = lambda v: [math.floor(1024 * x) for x in v]
    for q, own in ((0, [1.0, 2.0]), (6, [-2e6, 4e6])):
        got = [(r.vec_id, r.score) for r in vafile.top_products(fits, F.expr(f"vec_id = {q}")).orderBy("rank").collect()]
        want = sorted(((k, sum(a * b for a, b in zip(exact(v), exact(own)))) for k, v in rows if k not in (q, 3)), key=lambda t: (-t[1], t[0]))
        assert got == want[:10]
    with pytest.raises(Exception, match="range of a long"):
        vafile.top_products(df, F.expr("vec_id = 0")).collect()


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), None, ["a", "b", "c", None][0 if k % 3 == 0 else k % 4], 0) for k in range(300)]
    docs = spark.createDataFrame([*rows, rows[5]], DOCS)
    out = mixing.mix(docs).collect()
    assert len(out) == 301 and all(0 <= r.taken <= 3 * r.size for r in out)
    for s in ("a", "b", "c", None):
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].source_size == sum(r.size for r in own)
    assert math.isclose(sum({r.source: r.target for r in out}.values()), sum(r.size for r in out))
    words = lambda df: df.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words(mixing.mixed(docs)) == sum(r.taken for r in out)
    for copies, others in ((7, 30), (40, 9)):  # repeated rows share a budget that ends among them
        rows = [(1, "w " * 13, None, "a", 0)] * copies + [(k, "v " * 17, None, "b", 0) for k in range(2, others)]
        again = spark.createDataFrame(rows, DOCS)
        assert mixing.mixed(again).select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0] == sum(r.taken for r in mixing.mix(again).collect())
    assert Counter(map(tuple, mixing.mix(docs.repartition(5)).collect())) == Counter(map(tuple, out))
    assert mixing.mix(odd_docs(spark)).count() == len(ODD) + 1 and mixing.mix(docs.limit(0)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_path(model, rows):
    """Viterbi over a whole conversation's rows at once: the roles of first and last line of each row."""
    n, score, back = len(model.roles), model.start.copy(), []
    for k, lines in enumerate(rows):
        w = model.matrix(lines)
        into = np.vstack([model.start[None, :]]) if k == 0 else score[:, None] + model.move
        first_from = into.max(axis=0)
        total = first_from[:, None] + w
        back.append((into.argmax(axis=0), total.argmax(axis=0)))
        score = total.max(axis=0)
    last, out = int(score.argmax()), []
    for into, first in reversed(back):
        f = int(first[last])
        out.append((f, last))
        last = int(into[f])
    assert n == len(model.roles)
    return out[::-1]


def transcript(spark):
    rng, rows = random.Random(4), []
    for conv in range(30):
        for turn in range(rng.randint(1, 12)):
            role = "user" if turn % 2 == 0 else "assistant"
            text = "\n".join("word " * (rng.randint(2, 6) if role == "user" else rng.randint(15, 40)) + ("?" if role == "user" else ".") for _ in range(1 if role == "user" else rng.randint(1, 4)))
            rows.append((conv, turn, role, ("Human: " if role == "user" and rng.random() < 0.3 else "") + text))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("block", [2_048, 2])
def test_chat_blocks_give_the_best_path(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_ROWS", block)
    rows, df = transcript(spark)
    model = chat.fit(df)
    out = chat.parse(df.repartition(3), model).collect()
    roles = {(r.conv_id, r.turn): r.role for r in out if r.part == 0}
    assert sum(roles[c, t] == role for c, t, role, _ in rows) >= 0.95 * len(rows)
    for conv in range(30):
        own = [chat.lines_of(x[3]) for x in rows if x[0] == conv]
        assert [roles[conv, t] for t in range(len(own))] == [model.roles[f] for f, _ in brute_path(model, own)]


def test_chat_markers_and_odd_rows(spark):
    _, df = transcript(spark)
    model = chat.fit(df)
    text = "User: hi there?\nAssistant: hello, " + "a long answer " * 20 + ".\nmore of it.\n**Human:** and now?\n[Bot]: done."
    out = chat.parse(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string"), model).orderBy("part").collect()
    assert [r.role for r in out] == ["user", "assistant", "user", "assistant"] and out[3].rendered == "<|assistant|>\ndone.\n<|end|>\n" and out[1].content.endswith("\nmore of it.")
    odd = spark.createDataFrame([(None, 0, "a"), (None, None, None), (1, None, "Q: x"), (1, 0, " "), (1, 0, "Q: x"), (1, 0, "Q: x"), (2, 0, "y\n" * 5000)], "conv_id long, turn long, text string").withColumn("w", F.lit(1))
    out = chat.parse(odd, model).collect()
    assert sum(r.part == 0 for r in out) == 7 and sum(r.role is None for r in out) == 2
    assert chat.parse(odd.limit(0), model).count() == 0 and chat.fit(df.limit(0)).roles == ["assistant", "system", "user"]


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_lengths(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = lengths.encoded_lengths(odd_docs(spark).withColumn("n_tokens", F.lit("clash")), path, public_tokenizers.PATTERN).collect()
    own = lengths.Lengths(Path(path).read_bytes(), public_tokenizers.PATTERN)
    assert isinstance(own.encoding, tiktoken.Encoding)
    assert sorted(r.n_tokens for r in counted) == sorted(len(own.encoding.encode_ordinary(t or "")) for t in [*ODD, ODD[-1]])
    for run in (" " * 300, "\n \t" * 200):
        for text in (f"a{run}b", f"{run}", f"{run}b{run}", f"x {run}. "):
            assert own.count(text) == len(own.encoding.encode_ordinary(text))
    assert own.count("a" + " " * 2_000_000 + "b") > 0
    sizes = [r.n_tokens for r in counted] + [5_000, 5_000, 70]
    hist = lengths.histogram(spark.createDataFrame([(s,) for s in [*sizes, None]], "n_tokens long"))
    table = lengths.sums(hist)
    for r in table.collect():
        assert r.truncated_tokens == sum(min(s, r.n_tokens) for s in sizes) and r.docs_longer == sum(s > r.n_tokens for s in sizes) and r.tokens_at_most + r.tokens_longer == sum(sizes)
    totals = {r.limit: r.truncated_tokens for r in lengths.truncated_totals(table, [0, 3, 4_096, 10**6]).collect()}
    assert totals == {k: sum(min(s, k) for s in sizes) for k in totals} and len(totals) == 4
    assert {r.share: r.n_tokens for r in lengths.quantiles(table, [0.5, 1.0]).collect()} == {0.5: sorted(sizes)[math.ceil(len(sizes) / 2) - 1], 1.0: max(sizes)}
    assert lengths.sums(hist.limit(0)).count() == 0 and lengths.truncated_totals(lengths.sums(hist.limit(0)), [1]).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))
    texts = []
    for k in range(12):
        lines = [own(), own(), own()]
        if k < 6:
            lines.insert(1, f"Copyright 20{k:02} by the makers, all rights reserved")  # digits vary
        if k in (1, 2, 3, 4, 8):
            lines.append(f"The user called {rng.choice('abcdefgh')}{'xyzuvwrst'[k]}ab has joined the open channel today")  # a word varies
        if k in (9, 10):
            lines.append("this line occurs in two documents only")
        texts.append("\n".join(lines))
    copies = [own() + "\n" + own()] * 8
    nearly = [f"{copies[0]}x{'abcdefgh'[k]}" for k in range(8)]  # most lines recur: copies as a whole
    docs = spark.createDataFrame(list(enumerate(texts + copies + nearly)), "doc_id long, text string")
    rows = {r.doc_id: r for r in templates.drop_recurring(docs.repartition(3)).collect()}
    for k, t in enumerate(texts):
        want = "\n".join(x for x in t.split("\n") if not x.startswith(("Copyright", "The user")))
        assert rows[k].text == want and rows[k].lines_dropped == len(t.split("\n")) - len(want.split("\n"))
    assert all(rows[k].text == t for k, t in enumerate(texts + copies + nearly) if k >= len(texts))
    odd = templates.drop_recurring(odd_docs(spark).withColumn("lines_dropped", F.lit("clash")))
    assert odd.count() == len(ODD) + 1 and odd.where("lines_dropped <> 0").count() == 0
    assert templates.drop_recurring(docs.limit(0)).count() == 0


def test_line_dedup_of_mostly_recurring_documents(spark):
    rng = random.Random(5)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passages = [own(60) for _ in range(2)]
    texts = [f"{own(25)}\n{passages[k % 2]}" for k in range(12)]  # most of each recurs, but none is near another
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = templates.drop_recurring(docs).collect()
    assert all(r.text == texts[r.doc_id].split("\n")[0] and r.lines_dropped == 1 for r in rows) and len(rows) == 12


def test_line_dedup_of_long_lines(spark):
    rng = random.Random(7)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    long, short = own(60), own(40)
    texts = [f"{own(30)}\n{own(70)}\n{x}\n{own(30)}" for x in (long, long, short, short, long)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[4] + " x"])), "doc_id long, text string")
    rows = {r.doc_id: r for r in templates.drop_recurring(docs).collect()}
    assert [rows[k].lines_dropped for k in range(6)] == [1, 1, 0, 0, 1, 1] and all(long not in r.text for r in rows.values())
    assert templates.drop_recurring(docs, long_texts=5).where("lines_dropped > 0").count() == 0


def test_line_dedup_of_large_leaves(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    own = lambda: " ".join(word() for _ in range(24))
    # One template with more fillers than a task takes.
    texts = [f"{own()}\nThe user called {word()} has joined the open channel today\n{own()}" for _ in range(1_100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = templates.drop_recurring(docs).collect()
    assert all(r.lines_dropped == 1 and "joined" not in r.text for r in rows)
    # A few rare templates in a leaf of many lines that are like no other, of which many share a stretch of words.
    monkeypatch.setattr(templates, "LEAF_LINES", 64)
    ends = [" ".join(word() for _ in range(6)) for _ in range(3)]
    rare = [f"It is said {word()} {ends[k % 3]} {word()}" for k in range(18)]
    plain = [f"It is said {word()} {word()} {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(150)]
    shared = [f"It is said {word()} {word()} {word()} {word()} {word()} {word()} over there" for _ in range(150)]
    short = [f"Posted here by {word()}" for _ in range(300)]
    lines = rare + short + plain + shared
    docs = spark.createDataFrame([(k, f"{own()}\n{x}\n{own()}") for k, x in enumerate(lines)], "doc_id long, text string")
    dropped = {r.doc_id for r in templates.drop_recurring(docs).where("lines_dropped > 0").collect()}
    assert dropped == set(range(len(rare + short)))


def test_line_dedup_moves_no_text(spark, monkeypatch):
    """Digests of recurring lines go to the texts, however many texts have one; more digests than may be broadcast give the same rows."""
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20))
    texts = [f"{own()}\nAll rights are reserved here\n{own()}" for _ in range(40)] + [own(), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 10)  # fewer than the texts that lose a line
    out = templates.drop_recurring(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(k, t and t.replace("\nAll rights are reserved here", ""), int(k < 40)) for k, t in enumerate(texts)]
    for found in (out, templates.drop_recurring(docs, broadcast_lines=0)):
        assert sorted((r.doc_id, r.text, r.lines_dropped) for r in found.collect()) == want


def test_stored_tables_know_their_rows(spark):
    """The choice of a small side takes no job after the one that stores it; an empty or derived table is counted."""
    table = stored(spark.range(7).withColumnRenamed("id", "k"), "seven")
    calls = []
    table.limit = lambda n: calls.append(n)
    small_side(table)
    assert row_count(table, 3) == 7 and not calls
    assert row_count(stored(spark.range(7).where("id > 9"), "none"), 5) == 0 and row_count(spark.range(7), 5) == 5
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(small_side(table, 7)) and not hint(small_side(table, 6))


def test_parsed_lines_mark_tokens_with_digits():
    found = templates.parsed_lines("a0b \u0663x y\n0\n\nno digits here 7" + "x" * 1_000_000)
    assert [tokens for _, tokens in found] == [["<*>", "<*>", "y"], ["<*>"], [], ["no", "digits", "here", "<*>"]]
    assert templates.parsed_lines("x" * 1_000_000) == [(0, ["x" * 1_000_000])]
    assert templates.parsed_lines(None) == [(0, [])]


def test_clusters_generalise():
    table = np.array([[1, 2, 3, 4], [1, 2, 3, 9], [1, 2, 8, 9], [5, 6, 7, 8]])
    assert templates.clusters(table, 0.7).tolist() == [0, 0, 1, 2]
    assert templates.fields([str(k) for k in range(1000)]) and len(templates.fields(["x"] * 1000)) == templates.FIELDS


# --- 8 ---------------------------------------------------------------------------------------------------------------


@here
def test_language_id_on_held_out_documents(spark):
    found = queries.QUERIES["op8_language_id"](spark, str(DIR)).where("held_out")
    truth = spark.read.parquet(str(DIR / "documents.parquet")).select("doc_id", "lang", F.size(F.split("text", " ")).alias("n"))
    rows = found.join(truth, "doc_id").where("lang is not null and n >= 5 and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0


def test_language_id_against_a_dictionary(spark):
    """The backoff in plain Python: words by log frequency, unseen ones by their longest known n-grams."""
    rng = random.Random(8)
    langs = {x: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(60)] for x, letters in (("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "aeghij"))}
    say = lambda x: " ".join(rng.choices(langs[x], k=rng.randint(1, 12)) + [rng.choice(["12", "²", "", "ǅx"])])
    rows = [(k, say(x), x) for k in range(90) for x in langs]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.BackoffModel.fit(docs)
    letters = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    pieces = lambda v, n: [v[k : k + n] for k in range(len(v) - n + 1)]
    grams = lambda w, n: [w] if n == 0 else pieces(f"^{w}$" if n > 1 else w, n)
    counts = {(x, n): Counter(g for _, t, y in rows if x == y for w in letters(t) for g in grams(w, n)) for x in langs for n in range(6)}
    known = {n: {g for x in langs for g in counts[x, n] if sum(counts[y, n][g] for y in langs) > 1} for n in range(6)}
    log = lambda x, n, g: math.log((counts[x, n][g] + 0.1) / (counts[x, n].total() + 0.1 * len(known[n])))

    def brute(text):
        total = Counter({x: 0.0 for x in langs})
        for w in letters(text or ""):
            n = next((n for n in (0, 5, 4, 3, 2, 1) if any(g in known[n] for g in grams(w, n))), None)
            own = [g for g in grams(w, n) if g in known[n]] if n is not None else []
            for x in langs:
                total[x] += sum(log(x, n, g) for g in own) / max(1, len(own))
        size = len(letters(text or ""))
        share = {x: math.exp((v - max(total.values())) / max(1, size) * min(size, 20)) for x, v in total.items()}
        return (max(sorted(share), key=share.get), max(share.values()) / sum(share.values())) if size else ("und", 0.0)

    texts = [*ODD, *[t for _, t, _ in rows[:60]], *[f"{say('aa')} {say('bb')} zz é" for _ in range(40)], "q", "zzz yyy"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in langid.predict(asked, model).collect():
        lang, share = brute(texts[r.doc_id])
        assert math.isclose(r.score, share, abs_tol=1e-4) and (r.lang_pred == lang or math.isclose(share, 1 / 3, abs_tol=1e-4))
    with pytest.raises(ValueError):
        langid.BackoffModel.fit(spark.range(600).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.col("id").cast("string").alias("lang")))


def test_language_id_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = langid.BackoffModel.fit(docs)
    out = langid.predict(docs, model)
    assert out.count() == len(ODD) + 1 and all(0 <= r.score <= 1 for r in out.collect())
    assert {r.lang_pred for r in out.where("text is null or text in ('', '5 7 9')").collect()} == {"und"}
    empty = langid.BackoffModel.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [*ODD, "Hello, WORLD! it's 2024…", "naïve Ñandú ΑΣ İı ß", "<|endoftext|> in <|startoftext|>text", "é ﬁ 가나다 😀👍🏽", "x" * 5000, *("".join(rng.choices("abc ABC,.;'0123é\n\t ", k=rng.randint(1, 80))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for k, t in enumerate(texts):
        want = own.encode(t or "", add_special_tokens=False).ids
        assert rows[k].ids == want and rows[k].decoded == own.decode(want, skip_special_tokens=False)
    r = bpe.digests(bpe.round_trip(docs.where("doc_id = 10"), path)).first()
    want = own.encode(texts[10], add_special_tokens=False).ids
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.n_tokens == len(want)
    assert bpe.encode(docs.limit(0), path).count() == 0
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    assert {r.doc_id: r.decoded for r in decoded.collect()} == {k: r.decoded for k, r in rows.items()}


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    at = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 4 * both >= 3 * len(sets[a] | sets[b]):
                x, y = at[a], at[b]
                at = [min(x, y) if c in (x, y) else c for c in at]
    return at, [len(s) for s in sets]


def test_jaccard(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(150)]
    shared = [rng.choices(vocab, k=30) for _ in range(3)]
    texts = [t for t in ODD]
    for k in range(50):
        base = rng.choices(vocab, k=rng.randint(3, 90)) + (shared[k % 3] if k % 2 else [])
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words).upper() if k % 7 == 0 else " ".join(words))
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[-1]), (len(texts) - 1, texts[-1])], "doc_id long, text string").withColumn("component", F.lit("clash"))
    rows = jaccard.near_duplicates(docs.repartition(5)).collect()
    at, sizes = brute_components(texts)
    assert len(rows) == len(texts) + 2
    assert all((r.component_id, r.n_shingles) == (at[r.doc_id], sizes[r.doc_id]) for r in rows if r.doc_id is not None)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_jaccard_moves_texts_to_their_side_alone(spark):
    """Many documents meet one pivot: its text isn't shuffled to the side of the many, nor theirs to its."""
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "e f"), (3, None), (4, "g h"), (9, "i j"), (None, "k l")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 9), (2, 9), (4, 9), (9, 4)], "u long, v long")
    left, right = jaccard._sides(pairs, docs)
    assert left.columns == ["u", "u_text"] and right.columns == ["v", "v_text"]
    assert sorted(map(tuple, left.collect())) == [(1, "a b"), (2, "c d"), (2, "e f"), (4, "g h"), (9, "i j")]
    assert sorted(map(tuple, right.collect())) == [(4, "g h"), (9, "i j")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_edited_copies(spark, seed):
    """Groups in which copies reach the threshold with their original or with copies of equal edits, but seldom with each other; ids with several texts."""
    rng = random.Random(seed)
    vocab, rows = [f"w{k}" for k in range(2_000)], []
    for g in range(3):
        base = rng.choices(vocab, k=60 + 20 * g)
        parts = [rng.choices(vocab, k=4) for _ in range(6)]
        for k in range(70):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([1, 2, 4])] = rng.choice([*parts, rng.choices(vocab, k=2), []])
            rows.append(" ".join(words))
    rng.shuffle(rows)
    at, sizes = brute_components(rows)
    assert 6 < len(set(at)) < 150
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.near_duplicates(docs.repartition(4)).collect()}
    assert out == {k: (c, n) for k, (c, n) in enumerate(zip(at, sizes, strict=True))}
    # Rows of one id are one document: links of any of its texts join the others' groups.
    merged = [k if k % 9 else 0 for k in range(len(rows))]
    at2 = list(range(len(rows)))
    for k, c in enumerate(at):
        for a, b in ((k, c), (k, merged[k])):
            x, y = at2[a], at2[b]
            at2 = [min(x, y) if z in (x, y) else z for z in at2]
    docs = spark.createDataFrame([(merged[k], t) for k, t in enumerate(rows)], "doc_id long, text string")
    out = jaccard.near_duplicates(docs).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == {(m, at2[k]) for k, m in enumerate(merged)}
