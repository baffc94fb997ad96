import pytest
from pyspark.sql import functions as F

from fathomry.operators import advisor, maintain
from fathomry.sources import documents, store
from fathomry.streaming import outbox


def chunks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pos int, text string")


def test_hash_diff_is_a_multiset_match(spark):
    old, new = chunks(spark, [(1, 0, "a"), (1, 1, "a"), (1, 2, "b")]), chunks(spark, [(1, 0, "a"), (1, 1, "x"), (1, 2, "a"), (1, 3, "a")])
    diff = maintain.hash_diff(old, new)
    assert [r.reused for r in diff.orderBy("pos").collect()] == [True, False, True, False]
    row = maintain.diff_summary(diff).first()
    assert (row.n_chunks, row.embedded, row.first_change, row.cascade) == (4, 2, 1, 3)
    assert maintain.diff_summary(maintain.hash_diff(new, new)).first().embedded == 0
    pairs = [(r.deleted, r.inserted) for r in maintain.replaced(old, new).orderBy("n").collect()]
    assert pairs == [("b", "x"), (None, "a")]


def test_garbage_collection_series(spark):
    edits = spark.range(0, 301).select(F.lit(1).alias("doc_id"), F.col("id").alias("edit"), F.lit(60).alias("n_chunks"))
    last = maintain.gc_series(edits).orderBy("edit").collect()[-1]
    assert (480 + last.total_rows, last.stale_rows, 480 + last.kept_rows, last.kept_stale) == (18_540, 18_000, 600, 60)


def test_activation_waits_for_all_rows(spark):
    rows = spark.createDataFrame([(1, 12, k, True) for k in range(60)] + [(1, 13, k, k < 27) for k in range(60)], "doc_id long, version int, pos int, visible boolean")
    active, expected = spark.createDataFrame([(1, 12)], "doc_id long, version int"), spark.createDataFrame([(1, 13, 60)], "doc_id long, version int, n_rows long")
    safe = maintain.activated(active, rows, expected)
    assert safe.first().version == 12 and maintain.coverage(rows, safe, expected).first().coverage == 1.0
    early = spark.createDataFrame([(1, 13)], "doc_id long, version int")
    assert maintain.coverage(rows, early, expected).first().coverage == pytest.approx(0.45)
    landed = rows.withColumn("visible", F.lit(True))
    moved = maintain.activated(active, landed, expected)
    assert moved.first().version == 13
    kept = maintain.collected(landed, moved, keep=0)
    assert kept.count() == 60 and maintain.collected(kept, moved, keep=0).count() == 60


def test_versions_copy_vectors_of_equal_content(spark):
    old = chunks(spark, [(1, 0, "a")]).select("doc_id", "pos", "text", maintain.content_hash(F.col("text")).alias("hash"), F.array(F.lit(7.0)).alias("vector"))
    rows = maintain.write_version(old, chunks(spark, [(1, 0, "a"), (1, 1, "b")]), 2, lambda t: F.when(t.isNotNull(), F.array(F.lit(1.0)))).orderBy("pos").collect()
    assert [r.vector for r in rows] == [[7.0], [1.0]]


def test_reconciliation(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, hash string")
    known = spark.createDataFrame([(1, "a"), (2, "old"), (9, "z")], "doc_id long, hash string")
    assert {r.doc_id for r in maintain.drift(source, known).collect()} == {2, 3}
    fixed = maintain.reconciled(source, known)
    assert {tuple(r) for r in fixed.collect()} == {(1, "a"), (2, "b"), (3, "c")} and maintain.drift(source, fixed).count() == 0


def test_cache(spark):
    cache = spark.createDataFrame([("q", "3", {1: 1}), ("r", "x", {1: 1, 2: 1}), ("s", "y", {2: 1})], "key string, answer string, sources map<long,int>")
    active = spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, version int")
    assert {(r.key, r.valid) for r in maintain.cache_lookup(cache, active).collect()} == {("q", False), ("r", False), ("s", True)}


SAMPLES = {
    "transcript": "\n".join(f"Speaker{'AB'[k % 2]}: this is what I said in turn {k} of the meeting" for k in range(8)),
    "faq": "\n\n".join(f"Q: How is thing {k} done?\nA: By doing it well." for k in range(6)),
    "tabular": "name,a,b,c\n" + "\n".join(f"row{k},1,2,3" for k in range(20)),
    "code": "\n".join(f"def f{k}(x):\n    return x + {k};" for k in range(8)),
    "email": "From: a@b.c\nTo: d@e.f\nSubject: hello\n\nHi there\n> old words\n> more\nThanks\n",
    "legal": "\n".join(f"{k}.1 Duty\nThe tenant shall pay and must not sublet, see Section {k}.1 pursuant to law." for k in range(1, 7)),
}


@pytest.mark.parametrize("category", SAMPLES)
def test_categories(spark, category):
    row = advisor.recommend(advisor.classify(advisor.profile(spark.createDataFrame([(1, SAMPLES[category])], "doc_id long, text string"))), "small").first()
    assert row.category == category and row.high <= 360 and sum(r.share for r in row.ranked) == pytest.approx(1.0)


def test_signals_and_categories_by_sql(spark, tmp_path):
    import duckdb

    from fathomry.plans import oracle, queries
    from tests.test_queries import canonical

    odd = [None, "", "From: a\nSubject: b\n[10:15] Ann Lee: hello\nDate: x", "End. Of page\nPage 3\nbro-\nken \u4e2d\u6587 words", "Abstract\n\nMethods\nSee Table 3 et al. [1, 2]\nConclusion", "```\nx = 1;\n```\n# One\n## Two\n1.2 Three"]
    texts = [*SAMPLES.values(), *odd, "a lone paragraph without any end " * 30]
    rows = [(k, text, "en", "a") for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("doc_signals", "doc_category", "recommend"):
        df, found = getattr(queries, name)(spark, str(tmp_path)), con.execute(oracle.ORACLE_SQL[name])
        assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in found.description], found.fetchall())


def test_signals_of_odd_characters_by_sql(spark, tmp_path):
    """Word boundaries beside letters beyond ASCII, ends of lines and white space that only Java knows, letters that fold to ASCII."""
    import duckdb

    from fathomry.plans import oracle, queries
    from tests.test_queries import canonical

    texts = ["Best\u00e9 Thanks\u4e2d", "x\u2028Dear y\u0085Hi z\rHello", "under\x0bSection 3\n\x0b\nTo:\x0bx", "\u017fee Section 2 RE\u017fULTS Than\u212as", "one.\x0btwo. three\n \x0b \nfour"]
    rows = [(k, text, "en", "a") for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, found = queries.doc_signals(spark, str(tmp_path)), con.execute(oracle.ORACLE_SQL["doc_signals"])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in found.description], found.fetchall())


def test_profile_of_nothing(spark):
    row = advisor.classify(advisor.profile(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))).first()
    assert row.category == "narrative" and row.words == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"page  one\fpage two\f ")
    rows = documents.files(spark, str(tmp_path), lambda data: data.decode().split("\f")).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.text) for r in rows] == [("a.txt", 1, "one\ntwo"), ("b.pdf", 1, "page one"), ("b.pdf", 2, "page two"), ("b.pdf", 3, "[Empty page 3]")]
    pairs = documents.question_pairs(spark.createDataFrame([('[{"split":"train","q":"why","evidence":["a","b"]}]',), ("no json",), (None,)], "value string"))
    assert [(r.qi, r.q, r.evidence) for r in pairs.collect()] == [(0, "why", ["a", "b"])]
    page = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><h2>T</h2>z",)], "h string").select(documents.markup_text(F.col("h"))).first()[0]
    assert page.strip() == "a & b\n### T\nz"


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.version() == 0 and s.table("documents") is None
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    parts = spark.createDataFrame([(10, 1, "red fox"), (20, 2, "blue whale")], "chunk_id long, doc_id long, text string")
    s.upsert(docs, parts)
    s.cached(spark.createDataFrame([("q", "a", {"1": 1})], "key string, answer string, sources map<string,int>"))
    assert tuple(s.stats().first()) == (2, 2) and s.table("cache").count() == 1
    s.upsert(docs.where("doc_id = 1").withColumn("name", F.lit("new")), parts.where("doc_id = 1").withColumn("text", F.lit("green fox")))
    assert {r.term for r in s.table("postings").collect()} == {"green", "fox", "blue", "whale"} and s.table("cache").count() == 0
    s.delete(docs.where("doc_id = 2"))
    assert {r.term for r in s.table("postings").collect()} == {"green", "fox"} and s.table("documents").first().name == "new"
    s.clear()
    assert s.table("chunks").count() == 0


def _files(path):
    return {str(f) for f in path.rglob("*.parquet")}


def _store(spark, path, n=40, parts=8):
    s = store.Store(spark, str(path), parts)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("old").alias("name"))
    s.upsert(docs, docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.concat(F.lit("word term"), "doc_id").alias("text")))
    return s, docs


def test_postings_of_dealt_chunks_are_not_shuffled(spark, tmp_path):
    from fathomry.sources import store

    chunks = spark.createDataFrame([("a", 1, "red red car"), ("b", 2, "blue car"), ("a", 1, "red sky")], "chunk_id string, doc_id long, text string")
    made = store.postings_by_document(store.Store(spark, str(tmp_path))._dealt(chunks, "doc_id", 4), "_part")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the chunks
    rows = sorted(map(tuple, made.drop("_part").collect()))
    assert rows == sorted(map(tuple, store.postings_by_document(chunks).collect())) and ("red", "a", 1, 3) in rows


def test_store_rewrites_touched_partitions_only(spark, tmp_path):
    s, docs = _store(spark, tmp_path)
    before = s.manifest()["tables"]
    one = docs.where("doc_id = 7").withColumn("name", F.lit("new"))
    files = _files(tmp_path)
    s.upsert(one, one.select("doc_id").withColumn("chunk_id", F.col("doc_id")).withColumn("text", F.lit("other words")))
    after = s.manifest()["tables"]
    for name in ("documents", "chunks", "postings"):
        changed = [p for p in before[name]["folders"] if before[name]["folders"][p] != after[name]["folders"].get(p)]
        assert len(changed) == 1 and len(before[name]["folders"]) == 8
    assert len(_files(tmp_path) - files) == 3
    assert {(r.doc_id, r.name) for r in s.table("documents").collect()} == {(k, "new" if k == 7 else "old") for k in range(40)}
    assert {r.term for r in s.table("postings").where("doc_id = 7").collect()} == {"words"}
    assert s.table("documents", 1).where("name = 'new'").count() == 0  # the version before is still there
    assert s.vacuum(keep=1) == 0 and s.vacuum(keep=1, least_age_seconds=0) == 3 and s.table("chunks").count() == 40


class _Late(store.Store):
    """A writer whom another overtakes while it writes its first table."""

    other, writes = None, 0

    def _write(self, name, df, parts):
        self.writes += 1
        if self.other:
            self.other, other = None, self.other
            other()
        return super()._write(name, df, parts)


def test_of_two_writers_both_changes_stay(spark, tmp_path):
    s, docs = _store(spark, tmp_path)
    revise = lambda w, k, name: w.upsert(docs.where(f"doc_id = {k}").withColumn("name", F.lit(name)), spark.createDataFrame([], "chunk_id long, doc_id long, text string"))
    part = {r.doc_id: r.p for r in docs.select("doc_id", s._part(F.col("doc_id"), 8).alias("p")).collect()}
    same = next(k for k in range(1, 40) if part[k] == part[0])
    far = next(k for k in range(1, 40) if part[k] != part[0])
    for k, tries in ((same, 2), (far, 1)):  # the same partition: done again; another one: entered as it is
        late = _Late(spark, str(tmp_path))
        late.other = lambda k=k: revise(s, k, "first")
        began = s.version()
        assert revise(late, 0, "second") == began + 2 and late.writes == 3 * tries
        assert {r.doc_id: r.name for r in s.table("documents").where(f"doc_id in (0, {k})").collect()} == {0: "second", k: "first"}
    assert not s._create(s.version(), {}) and s.manifest()["tables"]  # a version is created once
    assert not [x for x in s._names("_manifests") if x.startswith(".") and not x.endswith(".crc")]


def test_a_store_has_the_partitions_of_its_first_writer(spark, tmp_path):
    docs, none = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("a").alias("name")), spark.createDataFrame([], "chunk_id long, doc_id long, text string")
    late = _Late(spark, str(tmp_path), 16)
    late.other = lambda: store.Store(spark, str(tmp_path), 4).upsert(docs, none)
    assert late.upsert(docs.where("doc_id < 10").withColumn("name", F.lit("b")), none) == 2 and late.manifest()["parts"] == 4
    assert {(r.doc_id, r.name) for r in late.table("documents").collect()} == {(k, "b" if k < 10 else "a") for k in range(30)}
    assert late.table("documents").count() == 30


def test_store_with_odd_rows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), 4)
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "doc_id long, name string")
    chunks = spark.createDataFrame([(1, 1, None), (2, None, "x"), (3, 9, "chunk without document")], "chunk_id long, doc_id long, text string")
    s.upsert(docs, chunks)
    assert {r.doc_id for r in s.table("documents").collect()} == {1, 2} and {r.chunk_id for r in s.table("chunks").collect()} == {1, 3}
    s.upsert(docs.limit(0), chunks.limit(0))
    s.upsert(docs.where("doc_id = 1").withColumn("more", F.lit(5)), chunks.limit(0))  # a new column
    assert {(r.doc_id, r.more) for r in s.table("documents").where("doc_id = 1").collect()} == {(1, 5)} and s.table("chunks").where("doc_id = 1").count() == 0
    s.delete(docs)
    assert s.table("documents").count() == 0 and s.table("chunks").count() == 1


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "a", "2024-01-01"), (1, 2, "b", "2024-01-02"), (1, 2, "b", "2024-01-02"), (2, 1, "c", "2024-01-01"), (1, 4, "d", "2024-01-03")], "doc_id long, version long, hash string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    for _ in range(2):  # again: nothing new
        outbox.start(outbox.event_stream(spark, str(tmp_path / "events")), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in outbox.indexed(spark, str(tmp_path / "index")).collect()} == {(1, 4, "d"), (2, 1, "c")}
    assert [tuple(r) for r in outbox.sequence_gaps(events).collect()] == [(1, 2, 4)]


def test_stream_of_files_that_overlap_in_time(spark, tmp_path):
    ends = F.expr("id div 100 * 7 % 16 * 86400")  # documents of a file end at different times
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 100 * 21_600 + ends)
    events = spark.range(1_600).select(F.expr("id div 100").alias("doc_id"), (F.col("id") % 100 + 1).alias("version"), F.md5(F.col("id").cast("string")).alias("hash"), ts.alias("ts"))
    events.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", "ts").write.parquet(str(tmp_path / "events"))
    assert len(list((tmp_path / "events").glob("*.parquet"))) == 8
    outbox.start(outbox.event_stream(spark, str(tmp_path / "events")), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in outbox.indexed(spark, str(tmp_path / "index")).collect()} == {tuple(r) for r in outbox.latest(events).collect()}


def test_one_document_is_reindexed_and_models_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "a", "m1"), (2, "b", "m1"), (2, "c", "m2")], "doc_id long, text string, model string")
    fresh = spark.createDataFrame([(2, "z", "m2")], rows.schema)
    assert {tuple(r) for r in maintain.reindexed(rows, fresh).collect()} == {(1, "a", "m1"), (2, "z", "m2")}
    assert {tuple(r) for r in maintain.model_mix(rows).collect()} == {("m1", 2), ("m2", 1)} and maintain.of_model(rows, "m2").count() == 1
    assert spark.range(1).select(maintain.projection_seconds(F.lit(20_000_000))).first()[0] == 10_000


def test_flagged_answers_are_not_cached(spark, tmp_path):
    from fathomry.functions import text

    s = store.Store(spark, str(tmp_path), 4)
    answers = spark.createDataFrame([("q1", "a", False), ("q2", "b", True), ("q3", "c", None), ("q1", "a", False)], "question string, answer string, flagged boolean")
    keyed = maintain.cacheable(answers).select(text.cache_key(F.lower("question"), F.lit(5)).alias("key"), "answer", F.create_map(F.lit("1"), F.lit(1)).alias("sources"))
    s.cached(keyed)
    s.cached(keyed.limit(1).withColumn("answer", F.lit("new")))
    assert s.table("cache").count() == 2 and s.table("cache").where("answer = 'new'").count() == 1
    keys = {tuple(r) for r in answers.select("question", text.cache_key(F.lower("question"), F.lit(5)), text.cache_key(F.lower("question"), F.lit(6))).collect()}
    assert len({k for _, a, b in keys for k in (a, b)}) == 6


def test_gaps_come_out_of_the_stream_over_files_in_any_order_and_a_restart(spark, tmp_path):
    import random

    from fathomry.streaming import tracking

    rng = random.Random(1)
    rows = [(d, v, f"{d}-{v}") for d in range(6) for v in range(1, 15) if rng.random() < 0.7] + [(None, 1, "x"), (1, None, "x"), (7, 3, None)]
    rows += rows[:5]  # repeated
    rng.shuffle(rows)
    files = [rows[k::4] for k in range(4)]
    for some in (files[:2], files[2:]):  # the second time from the checkpoint
        for own in some:
            spark.createDataFrame(own, "doc_id long, version long, hash string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        tracking.start(outbox.event_stream(spark, str(tmp_path / "events")), str(tmp_path / "states"), str(tmp_path / "check")).awaitTermination()
    states = tracking.tracked(spark, str(tmp_path / "states"))
    events = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None], "doc_id long, version long, hash string")
    assert {tuple(r) for r in tracking.gaps(states).collect()} == {tuple(r) for r in outbox.sequence_gaps(events).collect()}
    assert {(r.doc_id, r.version, r.hash) for r in states.collect()} == {tuple(r) for r in outbox.latest(events).collect()}
    assert tracking.merged([1, 2, 5, 5], [3, 9, 4, 4]) == [1, 5, 9, 9]
