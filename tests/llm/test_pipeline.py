from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fathomry.llm import jaccard
from fathomry.session import ARROW_ROWS

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(DIR / "documents.parquet"))
    for k, (_, stage) in enumerate(P.STAGES):
        before, columns = docs, docs.columns
        stage(spark, docs, str(DIR)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if k == 0:
            assert docs.count() >= 0.9 * before.count() and docs.where("lang is null").count() == 0
        if k == 1:
            assert docs.count() == before.count() and docs.where(F.length("text") > 0).count() >= before.where(F.length("text") > 0).count()
        if k == 2:
            groups = jaccard.near_duplicates(before)
            assert docs.count() == groups.where("doc_id = component_id").count()
            assert jaccard.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and docs.where("n_tokens > 0").count() > 0


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (2, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            table_out = stage(spark, table, "")
            assert table_out.count() <= 3 * docs.count()


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, text), (3, text), (2, text), (2, text), (None, other), (None, other), (7, None), (7, None), (8, " "), (2, other + " x y z")]
    docs = spark.createDataFrame([(k, t, None, None, 0, "clash") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component string")
    found = sorted(map(str, P.near_duplicates(spark, docs, "").select("doc_id", "text").collect()))
    assert found == sorted(f"Row(doc_id={k}, text={t!r})" for k, t in [(2, text), (None, other), (7, None), (7, None), (8, " "), (2, other + " x y z")])


def test_near_duplicates_go_without_a_shuffle_of_texts(spark, monkeypatch):
    """The few ids that go are sent to the documents."""
    plans, keep = {}, P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and keep(df, name))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        docs = spark.createDataFrame([(k, "one two three four five six", None, None, 0) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
        assert P.near_duplicates(spark, docs, "").count() == 1
    finally:
        spark.conf.set(name, before)
    assert "LeftAnti" in plans["left"] and "rightHint=(strategy=broadcast)" in plans["left"]


def test_language_id_drops_what_it_rejects(spark):
    docs = spark.createDataFrame([(k, t, x, None, 0) for k, (t, x) in enumerate([("aa bb aa cc", "x"), ("dd ee dd ff", "y"), ("aa cc bb", None), ("12 34", "x"), (None, "x")] * 20)], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.language_id(spark, docs, "")
    assert {(r.text, r.lang) for r in out.collect()} == {("aa bb aa cc", "x"), ("dd ee dd ff", "y"), ("aa cc bb", "x")} and out.count() == 60


def test_stages_bound_arrow_batches_when_called_by_themselves(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for step, stage in P.STAGES:
            spark.conf.set(name, "10000")  # Spark's default
            stage(spark, docs, "")
            assert spark.conf.get(name) == ARROW_ROWS, step
    finally:
        spark.conf.set(name, ARROW_ROWS)
