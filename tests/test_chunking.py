import random

import pytest
from pyspark.sql import functions as F

from fathomry.operators import chunking as C

DOC = """# Guide

## 1 Stay
### 1.1 Arrival
Guests arrive after noon. Keys wait at the desk, see Section 2.1.
### 1.2 Leaving
Rooms are free at ten. Late stays cost extra.

## 2 Money
### 2.1 Payment
Cards are taken. Cash is taken too. Refunds follow Section 1.2.
"""
QUESTIONS = [["Keys wait at the desk, see Section 2.1.", "Cards are taken."], ["Rooms are free at ten."], ["not in the text"]]


def test_pack():
    assert C.pack(["Aaaa.", "Bb.", "Cccc."], 10, 4) == ["Aaaa. Bb.", "Bb.  Cccc."]
    assert C.pack([], 10, 4) == []
    assert C.pack(["x" * 50], 10, 4) == ["x" * 50]


def test_parse():
    text, units, provisions = C.parse(DOC)
    assert [p["id"] for p in provisions] == ["1.1", "1.2", "2.1"]
    assert provisions[0]["path"] == ["1 Stay", "1.1 Arrival"]
    assert all(text[u["start"] : u["end"]] == u["text"] for u in units)
    assert C.parse("")[1] == []


def test_structure_follows_references():
    chunks = C.lab_structure(DOC)
    assert [c["refs"] for c in chunks] == [[2], [], [1]]
    assert chunks[0]["text"].startswith("[1 Stay › 1.1 Arrival]\nGuests arrive") and "↳ Section 2.1 Payment: Cards are taken." in chunks[0]["text"]


@pytest.mark.parametrize("size", [60, 120, 450])
def test_every_strategy_covers_the_units(size):
    _, units, _ = C.parse(DOC)
    for chunks in (C.lab_sentences(DOC, size), C.lab_segments(DOC, QUESTIONS, size), C.lab_overlapping(DOC, QUESTIONS, size)):
        assert all(any(c["start"] <= u["start"] and u["end"] <= c["end"] for c in chunks) for u in units)


def objective(cuts, spans, wholes, mu=0.05):
    return sum(sum(1 for a, b in spans + wholes if a >= j and b < i) - mu for j, i in cuts)


def test_segments_are_optimal():
    rng = random.Random(3)
    text, units, _ = C.parse(DOC)
    found = [q for q in C.located(text, units, QUESTIONS) if q]
    spans = [s for q in found for s in q]
    wholes = [(min(a for a, _ in q), max(b for _, b in q)) for q in found if len(q) > 1]
    best = objective([(c["first_unit"], c["end_unit"]) for c in C.lab_segments(text, QUESTIONS, 150)], spans, wholes)
    for _ in range(300):
        cuts, j = [], 0
        while j < len(units):
            most = max(i for i in range(j + 1, len(units) + 1) if i == j + 1 or units[i - 1]["end"] - units[j]["start"] <= 150)
            i = rng.randint(j + 1, most)
            cuts.append((j, i))
            j = i
        assert objective(cuts, spans, wholes) <= best + 1e-9


def test_records():
    assert [c["text"] for c in C.records("a,b,c,d\n1,2,3,4\n5,6,7,8", 16)] == ["a,b,c,d\n1,2,3,4", "a,b,c,d\n5,6,7,8"]
    assert len(C.records("From: a\nhi\n> old\nFrom: b\nyes")) == 2 and "> old" not in C.records("From: a\nhi\n> old")[0]["text"]
    assert len(C.records("def a():\n  1\ndef b():\n  2")) == 2
    assert C.records("") == []


def test_frames(spark):
    docs = spark.createDataFrame([(1, DOC), (2, ""), (3, None), (4, "   ")], "doc_id long, text string")
    fixed = C.fixed_chunks(docs, 50, 10)
    assert {r.doc_id for r in fixed.collect()} == {1}
    rows = fixed.orderBy("chunk_no").collect()
    assert rows[0].start == 0 and rows[-1].end == len(DOC) and all(b.start - a.start == 40 for a, b in zip(rows, rows[1:]))
    for strategy in C.STRATEGIES:
        d = docs.withColumn("questions", F.lit(None).cast("array<array<string>>"))
        assert {r.doc_id for r in C.lab_chunks(d, strategy).collect()} == {1}
    headed = C.with_heading_path(C.lab_chunks(docs, "fixed", 80), C.provisions(docs)).orderBy("chunk_no").collect()
    assert any(r.text.startswith("[1 Stay › 1.1 Arrival") for r in headed) and all(r.words == len(r.text.split()) for r in headed)
    assert C.preview(C.lab_chunks(docs, "struct")).first().references == 2


def test_sections(spark):
    schema = "doc_id long, title string, sections array<struct<id:string,title:string,paras:array<string>>>"
    docs = spark.createDataFrame([(1, "T", [("a", "A", ["p" * 30, "q" * 30]), ("b", "B", ["r" * 30])])], schema)
    stable = C.stable_chunks(docs).orderBy("pos").collect()
    assert [r.section for r in stable] == ["a", "a", "b"] and stable[2].text == "T › B\n" + "r" * 30
    windows = C.section_windows(docs, 40).orderBy("pos").collect()
    assert [r.section for r in windows] == ["a", "a", "b"]


def test_sentence_chunks_number_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "One. Two."), (1, 2, "Three."), (2, 1, None)], "doc_id long, page int, text string")
    assert [(r.doc_id, r.chunk_no, r.text) for r in C.sentence_chunks(pages).orderBy("doc_id", "chunk_no").collect()] == [(1, 0, "One. Two."), (1, 1, "Three.")]


def test_preview_falls_back_and_warns(spark):
    numbered = "1.1 First Rule\nAll must pay the fee on time.\n2.1 Second Rule\nSee Section 1.1 for the fee."
    docs = [(1, numbered), (2, "No headings at all. Just two sentences."), (3, "2.1 Only Rule\nOne rule."), (4, None), (5, ""), (6, "word " * 200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("used", F.lit("clash"))
    found = {r.doc_id: r for r in C.previewed(rows, "struct").collect()}
    assert {k: r.used for k, r in found.items()} == {1: "struct", **dict.fromkeys((2, 3, 4, 5, 6), "sentence")}
    assert found[1].heading_share > 0 and found[1].references == 1 and found[2].heading_share is None and found[3].heading_share is not None
    assert [(found[k].n_chunks, found[k].mean_chars, found[k].most_words, found[k].too_big) for k in (4, 5)] == [(0, 0, 0, False)] * 2
    assert {k for k, r in found.items() if r.too_big} == {6} and not C.previewed(rows, "struct", budget_words=1_000).where("too_big").count()
    supervised = {r.doc_id: (r.used, r.n_chunks) for r in C.previewed(rows, "qesov").collect()}
    assert supervised[2] == ("qesov", found[2].n_chunks) and {r.heading_share for r in C.previewed(rows, "record").collect()} == {None}
    assert C.previewed(rows.limit(0), "struct").count() == 0


def test_table_functions_give_the_chunks_of_the_operators(spark):
    from fathomry.operators import table_functions

    table_functions.register(spark)
    docs = spark.createDataFrame([(1, DOC, QUESTIONS), (2, None, None), (3, "", []), (4, "One line. Another one.", None)], "doc_id long, text string, questions array<array<string>>")
    docs.createOrReplaceTempView("guides")
    several = C.lab_chunks(docs, tuple(C.STRATEGIES), 120)
    for strategy in C.STRATEGIES:
        call = f"supervised_chunks(text, questions, '{strategy}', 120)" if strategy in C.SUPERVISED else f"chunks(text, '{strategy}', 120)"
        by_sql = spark.sql(f"SELECT doc_id, '{strategy}' AS strategy, c.* FROM guides, LATERAL {call} c")
        own = C.lab_chunks(docs, strategy, 120)
        assert own.count() and own.columns == by_sql.columns
        assert sorted(map(str, by_sql.collect())) == sorted(map(str, own.collect())) == sorted(map(str, several.where(F.col("strategy") == strategy).collect()))
    assert sorted(map(str, spark.sql("SELECT doc_id, u.* FROM guides, LATERAL document_units(text) u").collect())) == sorted(map(str, C.units(docs).collect()))
    assert sorted(map(str, spark.sql("SELECT doc_id, p.* FROM guides, LATERAL document_provisions(text) p").collect())) == sorted(map(str, C.provisions(docs).collect()))
    assert [tuple(r) for r in spark.sql("SELECT * FROM packed_sentences(array('Aaaa.', null, 'Bb.', 'Cccc.'), 10, 4)").collect()] == [(0, "Aaaa. Bb."), (1, "Bb.  Cccc.")]
    with pytest.raises(Exception, match="no strategy"):
        spark.sql("SELECT * FROM chunks('text', 'unheard of')").collect()


def test_strategies_share_one_pass(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    plan = C.lab_chunks(docs, ("fixed", "sentence", "struct"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
