"""Ranking metrics and groundedness scores as DataFrame plans and Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions.text import tokenize

LEAST_FAITHFUL, KEY_TERMS, LONG_TERM = 0.8, 15, 4


def labelled(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, rank, rel from ranked doc_ids and labels (doc_id, quality); what has no label isn't relevant."""
    rel = F.coalesce(F.col("quality") == 1, F.lit(False))
    return ranked.join(labels.select("doc_id", "quality"), "doc_id", "left").select("query_id", "rank", rel.alias("rel"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ranking_metrics(judged: DataFrame, k: int = 5) -> DataFrame:
    """query_id, precision, recall, mrr, ndcg, average_precision at ``k`` of judged rankings (query_id, rank, rel).

    Precision divides by k even for fewer rows; recall by what is relevant within the ranking.
    """
    hits = F.sum(F.col("rel").cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged.withColumn("hits", hits)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    rel, near = F.col("rel"), F.col("rank") <= k
    gain = F.coalesce(F.sum(F.when(rel & near, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
    out = rows.groupBy("query_id").agg(one(rel & near).alias("found"), one(rel).alias("all"), F.min(F.when(rel, F.col("rank"))).alias("first"), gain.alias("dcg"), F.coalesce(F.avg(F.when(rel, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("average_precision"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("all", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    ideal = F.when(F.col("all") > 0, best).otherwise(F.lit(0.0))
    return out.select("query_id", (F.col("found") / k).alias("precision"), _ratio(F.col("found"), F.col("all")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), _ratio(F.col("dcg"), ideal).alias("ndcg"), "average_precision")


def precision_recall_curve(judged: DataFrame) -> DataFrame:
    """query_id, point, precision, recall: the origin (1, 0) and a point for each hit."""
    w = Window.partitionBy("query_id")
    hits = F.sum(F.col("rel").cast("int")).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged.withColumn("hits", hits).withColumn("all", F.sum(F.col("rel").cast("int")).over(w)).where("rel")
    points = rows.select("query_id", F.col("hits").cast("long").alias("point"), (F.col("hits") / F.col("rank")).alias("precision"), (F.col("hits") / F.col("all")).alias("recall"))
    origin = judged.select("query_id").distinct().select("query_id", F.lit(0).cast("long").alias("point"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return origin.unionByName(points)


def recall_of_expected(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """recall: the share of queries (query_id, expected) whose document is among the k best."""
    hit = F.bool_or((F.col("rank") <= k) & (F.col("doc_id") == F.col("expected")))
    each = expected.join(ranked, "query_id", "left").groupBy("query_id").agg(F.coalesce(hit, F.lit(False)).alias("hit"))
    return each.agg(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("recall"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` or a function in it names it."""
    return F.transform(F.array(value), use)[0]


def token_coverage(query: Column, text: Column) -> Column:
    """Share of the query's tokens that occur in the text; 1 without tokens. Relevance of a context or an answer."""
    both = F.struct(tokenize(query).alias("tokens"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    share = lambda x: F.size(F.filter(x["tokens"], lambda t: F.contains(x["low"], t))) / F.greatest(F.size(x["tokens"]), F.lit(1))
    return _let(both, lambda x: F.when(F.size(x["tokens"]) == 0, F.lit(1.0)).otherwise(share(x)))


def numbers(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)))


def entities(answer: Column) -> Column:
    """Distinct capitalised words that don't begin a sentence, in lower case."""
    parts = F.split(answer, r"[.!?]+")
    words = F.transform(parts, lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "))
    rest = F.flatten(F.transform(words, lambda w: F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))))
    plain = F.transform(rest, lambda w: F.regexp_replace(w, r"[^a-zA-Z0-9_]", ""))
    return F.array_distinct(F.transform(F.filter(plain, lambda w: w.rlike("^[A-Z]")), F.lower))


def faithfulness(answer: Column, context: Column) -> Column:
    """score and mismatches (a struct) of an answer against its context: its numbers, entities and first key terms are looked up."""
    answer, context = F.coalesce(answer, F.lit("")), F.coalesce(context, F.lit(""))
    terms = F.slice(F.array_distinct(F.filter(tokenize(answer), lambda t: F.length(t) > LONG_TERM)), 1, KEY_TERMS)
    # A number may also stand inside a longer one, between its points.
    whole = F.transform(F.regexp_extract_all(context, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), lambda n: F.concat(F.lit("."), n, F.lit(".")))
    parts = F.struct(numbers(answer).alias("numbers"), entities(answer).alias("named"), terms.alias("terms"), F.lower(context).alias("low"), whole.alias("whole"))
    missing = lambda items, test, kind: F.transform(F.filter(items, lambda x: ~test(x)), lambda x: F.concat(F.lit(f'{kind} "'), x, F.lit('" not found in sources')))
    none = F.array().cast("array<string>")

    def looked_up(x: Column) -> Column:
        own = F.filter(x["terms"], lambda t: ~F.array_contains(x["named"], t))
        has = lambda n: F.exists(x["whole"], lambda w: F.contains(w, F.concat(F.lit("."), n, F.lit("."))))
        has_text = lambda t: F.contains(x["low"], t)
        found = F.concat(missing(x["numbers"], has, "Number"), missing(x["named"], has_text, "Entity"), missing(own, has_text, "Key term"))
        return F.struct(found.alias("found"), (F.size(x["numbers"]) + F.size(x["named"]) + F.size(own)).alias("checks"))

    def judged(x: Column) -> Column:
        mismatches = F.when(answer == "", none).when(context == "", F.array(F.lit("Entire context is empty"))).otherwise(x["found"])
        score = F.when(answer == "", F.lit(1.0)).when(context == "", F.lit(0.0)).when(x["checks"] == 0, F.lit(1.0)).otherwise(1 - F.size(x["found"]) / F.greatest(x["checks"], F.lit(1)))
        return F.struct(score.alias("score"), mismatches.alias("mismatches"))

    return _let(_let(parts, looked_up), judged)


def groundedness(answers: DataFrame) -> DataFrame:
    """``answers`` (query, answer, context) with context_relevance, answer_relevance, faithfulness, mismatches, flagged."""
    out = answers.withColumns({"context_relevance": token_coverage(F.col("query"), F.col("context")), "answer_relevance": token_coverage(F.col("query"), F.col("answer")), "_judged": faithfulness(F.col("answer"), F.col("context"))})
    out = out.withColumns({"faithfulness": F.col("_judged.score"), "mismatches": F.col("_judged.mismatches")}).drop("_judged")
    return out.withColumn("flagged", (F.col("faithfulness") < LEAST_FAITHFUL) & (F.size("mismatches") > 0))
