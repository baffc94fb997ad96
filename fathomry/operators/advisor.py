"""Document profiles, categories and chunking recipes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_CHARS, LEAST_SCORE = 80, 0.4
BUDGET_WORDS = {"small": 150, "medium": 400, "large": 1200}

# The signals' patterns, counted over a text with Unix line ends.
PATTERNS = {
    "md_headings": [r"(?m)^#{1,6}\s+\S"],
    "numbered_headings": [r"(?m)^\s*(?:#{1,6}\s+)?(?:§\s*)?\d+(?:\.\d+)+\.?\s+[A-Z]"],
    "clause_words": [r"(?i)\b(?:shall|must not|must|may not|hereinafter|pursuant|notwithstanding|provided that)\b"],
    "cross_refs": [r"(?i)\b(?:see|under|per|in accordance with)\s+(?:Section|Clause|Article|§|Chapter|Appendix)\s*\d+", r"\b(?:Section|Clause|Article)\s+\d+(?:\.\d+)+"],
    "speaker_turns": [r"(?m)^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?(?!(?:From|To|Cc|Bcc|Subject|Sent|Date|Re|Q|A|Question|Answer)\s*:)[A-Z][\w .'-]{1,30}:\s+\S"],
    "timestamps": [r"\[?\b\d{1,2}:\d{2}(?::\d{2})?\b\]?"],
    "email_headers": [r"(?im)^(?:From|To|Cc|Subject|Sent|Date):\s"],
    "quoted": [r"(?m)^>"],
    "qa_pairs": [r"(?im)^\s*(?:Q[:.]|Question:|\*\*Q|#+\s.*\?\s*$)", r"(?m)^[^\n]{8,140}\?\s*$"],
    "code_fences": [r"(?m)^```"],
    "code_lines": [r"(?m)^\s*(?:def |class |function |import |export |const |let |var |public |private |return\b|if \(|for \(|#include|SELECT |FROM )|[;{}]\s*$"],
    "table_lines": [r"(?m)^\s*\|.*\|\s*$", r"(?m)^[^,\n]+(?:,[^,\n]*){3,}$", r"(?m)^[^\t\n]+(?:\t[^\t\n]*){2,}$"],
    "ocr_breaks": [r"\w-\n\w", r"(?m)^\s*(?:Page \d+|\d+\s*$)"],
    "exotic_chars": [r"[^\x00-\x7F\x{A0}-\x{24F}\x{2010}-\x{2027}§›↳•]"],
    "section_words": [r"(?i)\b(?:abstract|introduction|related work|method(?:s|ology)?|results|conclusion|references)\b"],
    "section_lines": [r"(?im)^\W*(?:\d+\.?\s*)?(?:abstract|introduction|related work|method(?:s|ology)?|experiments?|results|discussion|conclusions?|references)\b"],
    "paper_citations": [r"\[\d+(?:,\s*\d+)*\]|et al\."],
    "figures": [r"\b(?:Table|Figure|Fig\.)\s*\d+"],
    "greetings": [r"(?im)^(?:Hi|Hello|Dear|Thanks|Regards|Best|Cheers)\b"],
}

# Category, strategy, least and most characters, overlap, heading path, resolved references, retrieval.
CATALOGUE = [
    ("legal", "struct", 250, 450, 0, True, True, "graph"),
    ("techdocs", "struct", 300, 600, 0, True, True, "flat"),
    ("research", "struct", 400, 700, 60, True, False, "flat"),
    ("faq", "record", 150, 400, 0, True, False, "flat"),
    ("transcript", "qesov", 500, 900, 120, False, False, "flat"),
    ("email", "record", 200, 600, 0, True, True, "graph"),
    ("narrative", "sentence", 600, 1000, 100, True, False, "flat"),
    ("scanned", "qesov", 400, 700, 80, False, False, "flat"),
    ("tabular", "record", 200, 500, 0, True, False, "flat"),
    ("code", "record", 400, 1200, 0, True, True, "graph"),
]
CATEGORIES = [c[0] for c in CATALOGUE]


#: What RE2 means by escapes that Java reads otherwise: boundaries of ASCII words, white space without the vertical tab.
_ESCAPES = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]"}
#: Letters that RE2 takes for ASCII ones when case doesn't count.
_FOLDED = {"s": "[s\u017f]", "S": "[s\u017f]", "k": "[k\u212a]", "K": "[k\u212a]"}


def java_pattern(pattern: str) -> str:
    """A pattern of RE2 for Java: only ``\\n`` ends a line, words and white space are ASCII, case as in RE2. Classes must hold no ``\\s``."""
    folded = _FOLDED if re.match(r"\(\?[a-z]*i", pattern) else {}
    return "(?d)" + re.sub(r"\\(.)|\(\?[a-z]+\)|[a-zA-Z]", lambda m: _ESCAPES.get(m[1], m[0]) if m[1] else folded.get(m[0], m[0]), pattern)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id and the signals of each text: pattern counts, sizes and means."""
    rows = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n").alias("t"))
    t = F.col("t")
    count = lambda patterns: reduce(Column.__add__, [F.regexp_count(t, F.lit(java_pattern(p))) for p in patterns])
    sentences = F.size(F.filter(F.split(t, java_pattern(r"(?<=[.!?])\s+")), lambda s: F.length(F.trim(s)) > 2))
    paragraphs = F.size(F.filter(F.split(t, java_pattern(r"\n\s*\n")), lambda p: p.rlike(r"\S")))
    words = F.regexp_count(t, F.lit(r"\S+"))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")))
    out = rows.select("doc_id", "t", F.length(t).alias("chars"), words.alias("words"), lines.alias("lines"), sentences.alias("sentences"), paragraphs.alias("paragraphs"), *[count(p).alias(name) for name, p in PATTERNS.items()])
    each = lambda n: F.coalesce(F.try_divide(F.col("words"), F.col(n)), F.lit(0.0))
    noise = F.col("ocr_breaks") + F.col("exotic_chars") / 5
    paragraph = F.col("words") / F.greatest("paragraphs", F.lit(1))
    return out.withColumns({"code_fences": F.col("code_fences") / 2, "ocr_noise": noise, "mean_sentence_words": each("sentences"), "mean_paragraph_words": paragraph}).drop("t", "ocr_breaks", "exotic_chars", "sentences", "paragraphs")


# Category, weight, signal, whether a share of the lines counts, scale. A count is divided by the scale, a share
# of the lines is multiplied by it; neither counts for more than 1. A category's score is the sum of its rows in this order.
WEIGHTS = [
    ("legal", 3, "numbered_headings", False, 4),
    ("legal", 2, "cross_refs", False, 2),
    ("legal", 2, "clause_words", False, 6),
    ("legal", 1, "headings", True, 4),
    ("techdocs", 2, "md_headings", False, 4),
    ("techdocs", 2, "code_fences", False, 1),
    ("techdocs", 1, "code_lines", True, 4),
    ("techdocs", -1, "clause_words", False, 8),
    ("research", 2, "named_sections", False, 3),
    ("research", 1, "paper_citations", False, 4),
    ("research", 1, "figures", False, 2),
    ("faq", 3, "qa_pairs", False, 4),
    ("faq", 1, "qa_pairs", True, 3),
    ("faq", -4, "speaker_turns", True, 2),
    ("transcript", 3, "speaker_turns", True, 2),
    ("transcript", 1, "timestamps", False, 6),
    ("email", 3, "email_headers", False, 3),
    ("email", 1, "quoted", False, 4),
    ("email", 1, "greetings", False, 2),
    ("narrative", 2, "mean_paragraph_words", False, 80),
    ("narrative", 1, "words", False, 600),
    ("narrative", -2, "headings", True, 6),
    ("narrative", -1, "speaker_turns", True, 3),
    ("scanned", 2, "ocr_noise", False, 6),
    ("scanned", 1, "unbroken", False, 1),
    ("tabular", 3, "table_lines", True, 1.5),
    ("code", 3, "code_lines", True, 2),
    ("code", -1, "clause_words", False, 4),
]
#: Words of a mean sentence from which a text without headings counts as unbroken.
UNBROKEN = 35


def _score(category: str) -> Column:
    """The category's rows of ``WEIGHTS`` over a profile, not below 0."""
    headings = F.col("md_headings") + F.col("numbered_headings")
    derived = {
        "headings": headings,
        "named_sections": F.when(F.col("section_words") > 0, F.col("section_lines")).otherwise(0),
        "unbroken": ((headings == 0) & (F.col("mean_sentence_words") > UNBROKEN)).cast("int"),
    }
    total = F.lit(0.0)
    for own, weight, signal, by_line, scale in WEIGHTS:
        if own == category:
            x = derived.get(signal, F.col(signal))
            x = x / F.greatest("lines", F.lit(1)) * scale if by_line else x / scale
            total = total + weight * F.least(F.lit(1.0), x)
    return F.greatest(total, F.lit(0.0))


def classify(profiles: DataFrame) -> DataFrame:
    """Profiles with ``ranked`` (category, score, share; best first, ties in catalogue order) and ``category``."""
    entries = F.array(*[F.struct(_score(c).alias("score"), F.lit(k).alias("place"), F.lit(c).alias("category")) for k, c in enumerate(CATEGORIES)])
    order = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(x["place"] - y["place"])
    rows = profiles.withColumn("entries", F.array_sort(entries, order))
    total = F.aggregate("entries", F.lit(0.0), lambda s, x: s + x["score"])
    rows = rows.withColumn("total", F.when(total > 0, total).otherwise(F.lit(1.0)))
    ranked = F.transform("entries", lambda x: F.struct(x["category"].alias("category"), x["score"].alias("score"), (x["score"] / F.col("total")).alias("share")))
    best = F.when(F.col("entries")[0]["score"] > LEAST_SCORE, F.col("entries")[0]["category"]).otherwise(F.lit("narrative"))
    return rows.withColumn("ranked", ranked).withColumn("category", best).drop("entries", "total")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "category string, strategy string, low int, high int, overlap int, heading_path boolean, resolve_refs boolean, retrieval string")


def recommend(classified: DataFrame, budget: str = "medium", retriever: str = "hybrid", pairs: bool = False) -> DataFrame:
    """A recipe for each classified document: strategy, low, high, overlap, lab_size, budget_words, retrieval and notes.

    ``budget``: small, medium or large; ``retriever``: bm25, dense or hybrid; ``pairs``: whether there are questions with
    evidence, without which the supervised strategy falls back to sentence windows.
    """
    words = BUDGET_WORDS[budget]
    most = int(words * 6 / 2.5 + 0.5)
    rows = classified.join(F.broadcast(catalogue(classified.sparkSession)), "category", "left")
    capped = F.col("high") > most
    high = F.when(capped, F.lit(max(150, most))).otherwise(F.col("high"))
    rows = rows.withColumn("capped", capped).withColumn("new_high", high)
    low = F.when(F.col("capped"), F.least("low", F.round(F.col("new_high") * 0.6).cast("int"))).otherwise(F.col("low"))
    unsupervised = (F.col("strategy") == "qesov") & F.lit(not pairs)
    rows = rows.withColumns({"low": low, "high": F.col("new_high"), "unsupervised": unsupervised})
    rows = rows.withColumn("strategy", F.when(F.col("unsupervised"), F.lit("sentence")).otherwise(F.col("strategy")))
    headings = F.col("md_headings") + F.col("numbered_headings")
    advice = {"bm25": "keep each heading with the text under it", "dense": "add keyword search for exact names and numbers", "hybrid": "fuse keyword and vector ranks"}[retriever]
    notes = [
        F.when(F.col("capped"), F.lit(f"size capped so that several chunks fit {words} words")),
        F.when(F.lit(budget == "large"), F.lit("with this budget better ranking gains more than better chunks")),
        F.when(F.col("unsupervised"), F.lit("collect questions with evidence to optimise boundaries")),
        F.when(F.lit(pairs) & (F.col("strategy") == "sentence") & ~F.col("unsupervised"), F.lit("compare with the supervised windows on held-out questions")),
        F.lit(advice),
        F.when((F.col("cross_refs") >= 2) & ~F.col("resolve_refs"), F.lit("resolve the cross-references when indexing")),
        F.when((headings >= 3) & (F.col("strategy") == "sentence"), F.lit("try chunks by structure, there are headings")),
        F.when(F.col("quoted") >= 3, F.lit("strip quoted lines first")),
    ]
    overlap = F.least(F.col("overlap"), F.round(F.col("high") * 0.25).cast("int"))
    lab = F.round((F.col("low") + F.col("high")) / 2).cast("int")
    return rows.withColumns({"overlap": overlap, "lab_size": lab, "budget_words": F.lit(words), "notes": F.filter(F.array(*notes), lambda x: x.isNotNull())}).drop("capped", "new_high", "unsupervised")
