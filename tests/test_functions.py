import math

import pytest
from pyspark.sql import functions as F

from fathomry.functions import text as T
from fathomry.functions import vectors as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Don't stop-gap été A_b x", ["stop-gap", "a_b"]), ("", []), (None, []), ("the THE a", []), ("a bcd efg", ["bcd", "efg"]), ("-- x", ["--"])],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, T.tokenize) == tokens


def test_normalize(spark):
    assert one(spark, "a\tb\r\n\nc  d é", T.normalize_text) == "ab c d"
    assert one(spark, "éx K", T.normalize_text) == "x K"
    assert one(spark, None, T.normalize_text) == ""


@pytest.mark.parametrize(
    ("text", "found"),
    [("One. Two! Three", ["One.", "Two!"]), ("no end", ["no end"]), ("The 1.2-metre wall. Ok.", ["2-metre wall.", "Ok."]), ("", []), ("a..b. c?!", ["b.", "c?!"]), ("...", ["..."])],
)
def test_sentences(spark, text, found):
    assert one(spark, text, T.sentences) == found


def test_sentences_of_a_long_text_without_ends(spark):
    assert one(spark, "x" * 200_000, T.sentences) == ["x" * 200_000]
    assert one(spark, "a.b" * 100_000 + ". End.", lambda c: F.size(T.sentences(c))) == 2


def test_stems_and_hashes(spark):
    assert one(spark, "wings", T.stem) == "w"
    assert one(spark, "runs", T.stem) == "runs"
    assert one(spark, "a", T.fnv_hex) == "e40c292c"
    assert one(spark, "foobar", T.fnv_hex) == "bf9cf968"


def test_small_functions(spark):
    assert one(spark, "see [1] and [Source 2]", T.citations) == [1, 2]
    assert one(spark, "2.3 Check-in\ntext", T.marked_headings) == "### 2.3 Check-in\ntext"
    assert one(spark, "every 3 years, every 4 years", lambda c: T.first_fact(c, r"every (\d) years")) == "3"
    assert one(spark, "a b a", lambda c: T.replace_first(c, "a", "xy")) == "xy b a"
    assert [one(spark, "", lambda c, s=s: T.duration(F.lit(s))) for s in (0.5, 12.0, 120.0, 10_000.0)] == ["<1s", "12s", "2 min", "2.8 h"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], None), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(V.dot(F.col("a"), F.col("b")), V.magnitude(F.col("a")), V.normalized(F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(3.0, 5.0, [0.6, 0.8]), (0.0, 0.0, [0.0, 0.0]), (0.0, 1.0, [1.0])]


def test_hashed_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([(1, "one two two three"), (2, ""), (3, None)], "id int, text string")
    sparse = V.hashed_sparse(df, "id", "text")
    assert [(r.id, round(r.n, 9)) for r in sparse.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()] == [(1, 1.0)]
    dense = V.dense(sparse, "id").first()
    assert len(dense.vector) == 1024 and math.isclose(sum(x * x for x in dense.vector), 1.0)


def test_sentences_as_the_pattern_has_them(spark):
    import random
    import re

    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "b ", " ", ".", ". ", "! ", "?", "\n", "3.5"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["X a. . Y b.", "X a. . . Y b.", "", "no end", ". .", "word " * 300, "a." * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.sentences(F.col("text")).alias("s")).collect()
    for r in rows:
        found = re.findall(r"[^.!?]+[.!?]+(?:\s|\Z)", texts[r.id]) or [texts[r.id]]
        assert list(r.s) == [x.strip() for x in found if x.strip()]


def test_counts_of_arrow_batches_equal_the_columns(spark, tmp_path):
    from fathomry.plans import queries

    texts = [None, "", " ", "a", "\ufeffThe  cats\u3000catting cat \u0130x \u212aeys", "!! -- __ caf\u00e9 e\u0301", "\x0b\x1cword\x85other\xa0end ", "running runs ran runs " * 40]
    spark.createDataFrame([(k, x, "en", "a") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.tokenize_stats(spark, str(tmp_path))
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()  # folds over tokens are interpreted
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", T.word_count(F.col("text")), T.token_count(F.col("text")), F.size(T.tokenize(F.col("text"))), F.size(F.array_distinct(T.stems(F.col("text")))))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
