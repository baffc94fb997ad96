import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomry.operators import chunking, graph, index, metrics, search


def close(a, b):
    return a == pytest.approx(b, abs=1e-6)


def test_bm25(spark):
    words = lambda n, extra: " ".join([*extra, *["pad"] * (n - len(extra))])
    docs = spark.createDataFrame([(1, words(10, ["zebra", "zebra"])), (2, words(20, [])), (3, words(30, []))], "chunk_id long, text string")
    rows = index.bm25(index.build_index(docs), spark.createDataFrame([(1, "zebra zebra"), (2, "nothing")], "query_id long, text string")).collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in rows] == [(1, 1, 1)] and close(rows[0].score, 1.569327)


def test_deleted_documents_leave_the_index(spark):
    docs = spark.createDataFrame([(1, "zebra one"), (2, "zebra two")], "chunk_id long, text string")
    left = index.without_documents(index.build_index(docs), spark.createDataFrame([(1,)], "doc_id long"), docs.select(F.col("chunk_id").alias("doc_id"), "chunk_id"))
    assert {r.term for r in left.postings.collect()} == {"zebra", "two"} and left.stats.first().n_chunks == 1


def scores(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double")


def test_fusion_of_one_side_is_that_side(spark):
    vector, keyword = scores(spark, [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)]), scores(spark, [(1, 3, 8.0), (1, 2, 4.0)])
    found = search.candidates(vector, keyword, k=2)
    order = lambda w: [r.chunk_id for r in search.fuse(found, w).orderBy("rank").collect()]
    assert order(1.0) == [1, 2, 3] and order(0.0) == [3, 2, 1]
    top = search.fuse(found, 0.5).orderBy("rank").first()
    assert top.chunk_id == 3 and close(top.score, 0.55) and top.keyword_score == 8.0
    assert {(r.mode, r.chunk_id) for r in search.modes(found, 1).collect()} == {("hybrid", 3), ("keyword", 3), ("vector", 1)}


def test_proximity():
    assert close(search._closeness(["red", "green", "blue"], "a red green blue b".split()), 0.885714)
    assert search._closeness(["red"], ["red"]) == 0 and search._closeness(["red", "green"], ["red"]) == 0
    assert search._closeness(["red", "green"], ["red"] * 101 + ["green"]) == 0


def test_groundedness_computes_each_part_once(spark):
    rows = spark.createDataFrame([("red car", "Ann Lee drove 3.5 miles. It was in Rome.", "red 13.5 Lee"), ("", "", None), ("x y", "9", "")], "query string, answer string, context string")
    plan = metrics.groundedness(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # of the answer and of the context
    assert plan.count("array_distinct") == 3  # numbers, entities, key terms


def test_proximity_counts_every_place():
    from itertools import product

    assert close(search._closeness(["red", "green"], ["red"] * 101 + ["green"]), 0.6 + 0.4 / 1.2)
    rng = np.random.default_rng(3)
    for _ in range(50):
        words = [f"w{k}" for k in rng.integers(0, 6, 30)]
        tokens = [f"w{k}" for k in rng.integers(0, 8, 4)]
        present = [t for t in tokens if t in words]
        spans = [max(c) - min(c) for c in product(*[[k for k, w in enumerate(words) if w == t] for t in present])]
        assert close(search._closeness(tokens, words), 0.6 * len(present) / 4 + 0.4 / (1 + min(spans) / 5) if len(present) > 1 else 0)


def test_rerank_and_context(spark):
    rows = [(1, "red car", 1, 1, "red red wine car", 0.2), (1, "red car", 2, 2, "a red car", 0.2)]
    found = spark.createDataFrame(rows, "query_id long, query string, chunk_id long, page int, text string, score double").withColumn("name", F.lit("n"))
    ranked = search.rerank(found, "proximity")
    assert ranked.orderBy("rank").first().chunk_id == 2
    text = search.context(ranked).first().context
    assert text.startswith("[Source 1: n (Page 2)]\na red car\n---\n[Source 2: n (Page 1)]")
    assert search.rerank(found, "none").orderBy("rank").first().chunk_id == 1
    with pytest.raises(ValueError):
        search.rerank(found, "other")


def test_ranking_metrics(spark):
    judged = spark.createDataFrame([(1, k + 1, r) for k, r in enumerate([False, True, True, False])] + [(2, 1, False)], "query_id long, rank int, rel boolean")
    rows = {r.query_id: r for r in metrics.ranking_metrics(judged, 4).collect()}
    assert close(rows[1].mrr, 0.5) and close(rows[1].ndcg, 0.693426) and close(rows[1].average_precision, 0.583333) and rows[1].precision == 0.5
    assert (rows[2].mrr, rows[2].ndcg, rows[2].recall) == (0, 0, 0)
    assert close({r.query_id: r for r in metrics.ranking_metrics(judged, 3).collect()}[1].precision, 0.666667)
    points = [(r.point, r.precision, r.recall) for r in metrics.precision_recall_curve(judged).where("query_id = 1").orderBy("point").collect()]
    assert points == [(0, 1.0, 0.0), (1, 0.5, 0.5), (2, pytest.approx(2 / 3), 1.0)]


def test_faithfulness(spark):
    rows = [("q", "Revenue grew 12.5 percent in Paris.", "revenue grew in paris"), ("q", "", "x"), ("q", "Some answer", ""), ("the", "a b", "c")]
    out = metrics.groundedness(spark.createDataFrame(rows, "query string, answer string, context string")).collect()
    assert out[0].faithfulness == 0.5 and out[0].mismatches == ['Number "12.5" not found in sources', 'Key term "percent" not found in sources'] and out[0].flagged
    assert [r.faithfulness for r in out[1:]] == [1.0, 0.0, 1.0] and out[3].context_relevance == 1.0


def test_page_rank_mass():
    p = graph.rank_mass(3, np.array([0]), np.array([1]), np.array([2.0]), np.array([1.0, 0.0, 0.0]))
    assert close(p.sum(), 1.0) and p[2] == 0 and p[0] > p[1] > 0
    assert close(graph.rank_mass(1, np.array([], int), np.array([], int), np.array([]), np.array([1.0])).sum(), 0.5)


def test_graph_and_assembly(spark):
    text = "## 1 A\n### 1.1 One\nThe red fox runs fast. See Section 1.2.\n### 1.2 Two\nA blue whale swims far away.\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = chunking.lab_chunks(docs, "struct")
    kinds = {(r.a, r.b, r.kind) for r in graph.edges(chunks, chunking.provisions(docs)).collect()}
    assert {(0, 1, "adjacent"), (0, 1, "xref")} <= kinds
    asked = spark.createDataFrame([(1, 7, "red fox", ["A blue whale swims far away."])], "doc_id long, query_id long, q string, evidence array<string>")
    flat = graph.lab_scores(chunks, asked)
    both = graph.graph_scores(flat, graph.edges(chunks, chunking.provisions(docs)))
    assert {r.chunk_no for r in both.collect()} == {0, 1}
    rows = both.join(chunks.select(F.col("chunk_no").cast("long").alias("chunk_no"), "words", F.split("text", " ").alias("terms")), "chunk_no")
    picked = graph.assemble(rows, (5, 200))
    assert {r.budget for r in picked.collect()} == {200}
    assert graph.evidence_recall(picked, chunks, asked, ["strategy", "budget"]).first().complete == 1.0


ODD = ["Don't STOP-me_now twice", "", None, " \t\n ", "ÉCOLE İx Kelvin K", "a b c,d", "café--x " * 40, "x" * 3_000, "😀 emoji 5.5", "﻿start end　"]


def test_tokens_of_batches_are_those_of_columns(spark):
    import pyarrow as pa

    from fathomry.functions import arrow_text, text

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string").coalesce(1)
    found = rows.select(text.tokenize(F.col("t")), text.stems(F.col("t")), text.token_count(F.col("t")), F.filter(text.raw_tokens(F.col("t")), lambda x: x != "")).orderBy("k").collect()
    for shift in (0, 3):  # also of a slice
        texts = pa.array([None] * shift + ODD).slice(shift)
        plain, counts = arrow_text.terms(texts)
        tokens, row, _ = arrow_text.raw_tokens(texts)
        assert plain.to_pylist() == [r[0] for r in found] and arrow_text.terms(texts, True)[0].to_pylist() == [r[1] for r in found] and counts.tolist() == [r[2] for r in found]
        assert list(zip(row.tolist(), tokens.cast(pa.string()).to_pylist(), strict=True)) == [(k, t) for k, r in enumerate(found) for t in r[3]]
    hashes = spark.createDataFrame([("ab",), ("a-b_9",)], "t string").select(text.fnv1a(F.concat(F.lit("v1|"), "t"))).collect()
    assert arrow_text.fnv1a(pa.array([b"ab", b"a-b_9"]), "v1|").tolist() == [r[0] for r in hashes]


def test_bm25_by_blocks_equals_all_scores(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(30)], k=rng.randint(0, 40)))) for k in range(300)]
    docs += [(300 + k, docs[7][1]) for k in range(50)] + [(400, None), (401, "")]  # ties
    rows = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(rng.choices(words, k=5))) for k in range(20)] + [(20, ""), (21, None), (22, "absent")], "query_id long, text string")
    for tokenizer, measure in (("plain", "words"), ("stem", "tokens")):
        for size, at_once in ((512, 500_000), (16, 30)):
            monkeypatch.setattr(index, "BLOCK_CHUNKS", size)
            monkeypatch.setattr(index, "ASKED_TERMS", at_once)
            built = index.build_index(rows, tokenizer=tokenizer, measure=measure)
            assert {tuple(r) for r in built.postings.collect()} == {tuple(r) for r in index.postings(rows, tokenizer=tokenizer).collect()}
            key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
            assert key(index.bm25(built, asked, 10)) == key(index.top(index.scores(built, asked), 10))
    assert index.bm25(built, asked.limit(0)).count() == 0 and index.bm25(index.build_index(rows.limit(0)), asked).count() == 0


def test_dense_search_makes_no_row_for_each_pair(spark, monkeypatch):
    """Odd vectors too: null ones, other lengths, null elements, no number, repeated rows, ties."""
    monkeypatch.setattr(search, "MATRIX_ROWS", 3)
    monkeypatch.setattr(search, "MATRIX_CHUNKS", 2)
    monkeypatch.setattr(search, "DENSE_QUERIES", 4)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(60)]
    rows += [(60, None), (61, [1.0]), (62, [1.0, None, 0.0, 2.0]), (63, []), (5, [2.0, 2.0, 2.0, 2.0]), (64, [float("nan"), 0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(3)
    asked = chunks.where("chunk_id % 7 = 0 or chunk_id > 59").withColumnRenamed("chunk_id", "query_id")
    for k in (1, 5, 100):
        found = search.vector_topk(chunks, asked, k)
        every = search.top(search.similarities(chunks, asked), k)
        rows_of = lambda df: sorted(map(str, df.select("query_id", "chunk_id", F.round("score", 6), "rank").collect()))
        assert rows_of(found) == rows_of(every)
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_deleted_chunks_leave_blocks_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 4)
    monkeypatch.setattr(index, "DEAD_AT_ONCE", 3)
    docs = spark.createDataFrame([(k, f"word{k % 5} common{k} all all" if k != 7 else "") for k in range(20)] + [(None, "without id")], "doc_id long, text string").coalesce(2)
    gone = docs.where("doc_id % 3 = 0 or doc_id < 5")
    left = index.without_documents(index.build_index(docs, key="doc_id"), gone, docs.select("doc_id", F.col("doc_id").alias("chunk_id")))
    rest = docs.where("doc_id is null or not (doc_id % 3 = 0 or doc_id < 5)")
    fresh = index.build_index(rest, key="doc_id")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(left.postings.select("term", "chunk_id", "tf")) == rows(fresh.postings.select("term", "chunk_id", "tf")) and rows(left.lengths) == rows(fresh.lengths)
    asked = spark.createDataFrame([(1, "word1 all"), (2, "common13")], "query_id long, text string")
    assert rows(index.bm25(left, asked)) == rows(index.bm25(fresh, asked))


def test_blocks_are_written_and_read_a_few_at_once(spark, monkeypatch):
    """A row group of all a task's blocks would be one batch of the reader."""
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 1)
    rows = spark.createDataFrame([(k, f"word{k} common") for k in range(20)], "chunk_id long, text string").coalesce(1)
    built = index.build_index(rows)
    (file,) = built.blocks.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert groups.num_rows == 20 and max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) <= index.BLOCKS_AT_ONCE
    found = index.bm25(built, spark.createDataFrame([(1, "common word7")], "query_id long, text string"), 20).orderBy("rank").collect()
    assert len(found) == 20 and found[0].chunk_id == 7


def test_most_blocks_of_a_rare_and_common_query_are_skipped():
    import pyarrow as pa

    # Each chunk has the common word, few have the rare one too.
    terms = [["common", *["rare"] * (k in (3, 5, 8))] for k in range(4_000)]
    scorer = index.Scorer(["common", "rare"], np.log(1 + (4_000 - np.array([4_000, 3]) + 0.5) / (np.array([4_000, 3]) + 0.5)), np.array([0, 1]), np.array([0, 0]), 1, 2.0, 3)
    for first in range(0, 4_000, 100):
        block = index._block(pa.array(range(first, first + 100)), pa.array([2] * 100, pa.int64()), pa.array(terms[first : first + 100]))
        scorer.block({c: block.column(c)[0].values for c in index._BLOCK})
    assert (scorer.read, scorer.skipped) == (1, 39) and [x[1] for x in scorer.best.found[0]] == [3, 5, 8]


def test_sparse_search_filters_before_it_ranks(spark, monkeypatch):
    from fathomry.functions.vectors import hashed_rows, hashed_sparse

    texts = [(k, f"word{k % 7} word{k % 3} term{k}") for k in range(60)] + [(60, ""), (61, None)]
    rows = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    asked = rows.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    vectors, queries = hashed_rows(rows, "chunk_id", "text").withColumn("part", F.col("chunk_id") % 2), hashed_rows(asked, "query_id", "text")
    monkeypatch.setattr(search, "MATRIX_ROWS", 2)
    monkeypatch.setattr(search, "MATRIX_CHUNKS", 7)
    every = search.sparse_similarities(hashed_sparse(rows, "chunk_id", "text"), hashed_sparse(asked, "query_id", "text"))
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
    assert key(search.sparse_topk(vectors, queries, 4)) == key(index.top(every, 4))
    seen = rows.where("chunk_id > 20").select("chunk_id")
    found = search.sparse_topk(vectors, queries, 4, visible=seen, where="part = 1")
    assert key(found) == key(index.top(every.where("chunk_id > 20 and chunk_id % 2 = 1"), 4))
    pairs = every.where("chunk_id > 50").select("query_id", "chunk_id")
    exact = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 8)) for r in df.collect())
    assert exact(search.sparse_cosines(vectors, queries, pairs)) == exact(every.where("chunk_id > 50"))


def test_passages_are_found_wherever_they_begin(spark):
    import random

    from fathomry.operators import locate

    rng = random.Random(2)
    words = ["ab", "abc", "é😀", "x.", "yy", " "]
    docs = [(k, rng.choice(["", "pre"]) + " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "post\n"])) for k in range(80)] + [(80, None), (81, ""), (82, "the whole passage stands here twice: the whole passage stands here")]
    asked = [(k, t[a : a + rng.randint(1, 25)]) for k, (_, t) in enumerate(docs[:60]) for a in [rng.randint(0, max(0, len(t) - 1))]] + [(90, None), (91, ""), (92, "whole passage stands"), (93, "nowhere to be found at all")]
    found = locate.located(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"))
    expected = {(d, q, t.find(p), t.find(p) + len(p)) for d, t in docs if t for q, p in asked if p and p in t}
    assert {tuple(r) for r in found.collect()} == expected and (82, 92, 4, 24) in expected
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_spread_is_rank_mass_in_a_table(spark):
    import random

    rng = random.Random(4)
    pairs = [(rng.randint(0, 19), rng.randint(0, 19), rng.choice([0.5, 1.0, 2.0])) for _ in range(40)] + [(25, 26, 1.0), (25, 26, 1.0)]
    starts = {1: {0: 0.75, 3: 0.25}, 2: {25: 1.0}, 3: {30: 1.0}}  # the last has no links
    links = spark.createDataFrame([*pairs, (None, 3, 1.0), (1, 2, None)], "a long, b long, weight double")
    seeds = spark.createDataFrame([(q, n, m) for q, own in starts.items() for n, m in own.items()], "query_id long, node long, mass double")
    found = {(r.query_id, r.node): r.mass for r in graph.spread(links, seeds).collect()}
    a, b, w = (np.array(x) for x in zip(*pairs))
    for q, own in starts.items():
        start = np.zeros(31)
        start[list(own)] = list(own.values())
        expected = graph.rank_mass(31, a, b, w, start)
        assert all(close(found.get((q, n), 0.0), m) for n, m in enumerate(expected.tolist()))
    assert {(r.query_id, r.node): r.mass for r in graph.spread(links.limit(0), seeds, 3).collect()} == {(q, n): m / 2 for q, own in starts.items() for n, m in own.items()}
    few = graph.spread(links, seeds, least=0.05).count()
    assert 0 < few < len(found)


def test_stages_are_counted_as_they_run(spark):
    stages = search.Stages(spark)
    rows = stages.run("all", spark.range(10))
    stages.run("some", rows.where("id < 3"))
    stages.run("none", rows.limit(0))
    assert [(r.stage, r.n_rows) for r in stages.table().collect()] == [("all", 10), ("some", 3), ("none", 0)] and all(r.seconds > 0 for r in stages.table().collect())


def test_a_worker_loads_a_model_once_and_gets_rows_by_length(spark, tmp_path):
    import os
    import uuid

    from fathomry.operators import maintain, models

    folder, name = str(tmp_path), uuid.uuid4().hex

    def load():
        with open(f"{folder}/loaded-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def embed(texts):
            assert len(texts) <= 4 and None not in texts
            with open(f"{folder}/batch-{uuid.uuid4().hex}", "w") as f:
                f.write(" ".join(str(len(t)) for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    embed = models.hook(name, load, "array<double>", 4)
    rows = spark.range(40).select(F.col("id").alias("chunk_id"), F.when(F.col("id") != 7, F.repeat(F.lit("x"), (F.col("id") * 7 % 20).cast("int"))).alias("text")).repartition(5)
    for _ in range(2):
        found = {r.chunk_id: r.v for r in rows.withColumn("v", embed(F.col("text"))).collect()}
        assert found == {k: None if k == 7 else [float(k * 7 % 20), 1.0] for k in range(40)}
    pids = [f.name.split("-")[1] for f in tmp_path.glob("loaded-*")]
    assert len(pids) == len(set(pids)) > 0
    batches = [list(map(int, f.read_text().split())) for f in tmp_path.glob("batch-*")]
    assert all(b == sorted(b) for b in batches) and sum(map(len, batches)) == 78

    # In a dense search, in a new version of an index, and as a reranker.
    vectors = rows.where("text is not null").select("chunk_id", embed(F.col("text")).alias("vector"))
    best = search.vector_topk(vectors, vectors.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id"), 1)
    assert best.first().chunk_id in {k for k in range(40) if k * 7 % 20 == 19}
    chunks = spark.createDataFrame([(1, 0, "aa"), (1, 1, "bbb")], "doc_id long, pos int, text string")
    empty = spark.createDataFrame([], "doc_id long, hash string, vector array<double>")
    known = maintain.write_version(empty, chunks.where("pos = 0"), 1, embed)
    again = maintain.write_version(known, chunks, 2, embed).orderBy("pos").collect()
    assert [r.vector for r in again] == [[2.0, 1.0], [3.0, 1.0]]
    scorer = models.hook(f"{name}-cross", lambda: lambda queries, texts: [float(q in t) for q, t in zip(queries, texts)], "double")
    found = spark.createDataFrame([(1, "b", 1, "abc", 0.1), (1, "b", 2, "xyz", 0.9)], "query_id long, query string, chunk_id long, text string, score double")
    assert search.rerank(found, "neural", scorer).orderBy("rank").first().chunk_id == 1
