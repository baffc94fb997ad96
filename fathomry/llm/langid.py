"""Language identification: word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its character n-grams,
the longest order of which any is known, down to single characters. The model is fitted on a bounded sample
of labelled documents; prediction covers every whole text and needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.common import small_side, stored, text_slices

#: Longest character n-gram of the backoff.
ORDER = 5
#: Labelled documents per language that the model is fitted on, about (a hash picks them). Bounds the model.
DOCS_PER_LANGUAGE = 1_000
SMOOTHING = 0.1
#: The words of a document count as at most so many independent ones in its confidence.
EVIDENCE = 20
#: More languages than this are taken for an error in the labels: the model, which goes to every worker, grows with them.
MOST_LANGUAGES = 500
#: Unseen words whose scores a worker keeps.
_KEPT = 50_000

_RUNS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _RUNS.findall(text.lower())
    # Numerals such as superscripts pass the pattern; they aren't letters.
    return found if text.isascii() else [y for x in found for y in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams; those of two and more characters see the word's two ends."""
    if n > 1:
        word = f"^{word}$"
    return [word[k : k + n] for k in range(len(word) - n + 1)]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (order 0) and of their n-grams, by language."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found = Counter()
            for text in texts:
                found.update(words(text))
            counts = [found, *(Counter() for _ in range(ORDER))]
            for word, k in found.items():
                for n in range(1, ORDER + 1):
                    for g in grams(word, n):
                        counts[n][g] += k
            for n, c in enumerate(counts):
                if not c:
                    continue
                yield pd.DataFrame({"lang": lang, "n": n, "item": list(c.keys()), "k": list(c.values())})


class BackoffModel:
    """Log frequencies of words and n-grams for each language."""

    def __init__(self, langs: list[str], items: list[dict[str, int]], logs: list[np.ndarray]):
        self.langs, self.items, self.logs = langs, items, logs
        self.kept: dict[str, int] = {}
        self.rows = np.empty((0, len(langs)), np.float32)

    @classmethod
    def fit(cls, docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> BackoffModel:
        """Fit on rows with a text and a lang, of which a hash of doc_id keeps about ``docs_per_language`` each.

        Texts are counted whole, however long. Empty texts count as documents but teach nothing; rows of null doc_id are
        kept or left out together; repeated rows count each. Other columns are not read. Without rows the model knows no
        language. More than MOST_LANGUAGES languages raise a ValueError.
        """
        docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
        rates = stored(docs.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.count(F.lit(1))).alias("rate")), "rates")
        share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = docs.join(small_side(rates), "lang").where(share < F.col("rate")).select("lang", "text")
        counts = stored(sample.mapInPandas(_counted, "lang string, n int, item string, k long").groupBy("lang", "n", "item").agg(F.sum("k").alias("k")), "counts")
        sums = counts.groupBy("lang", "n").agg(F.sum("k").alias("k")).toPandas()
        langs = sorted(sums["lang"].unique())
        if len(langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(langs)} languages, more than {MOST_LANGUAGES}")
        # What is seen once says little and would be most of the model; such words back off.
        each = F.map_from_entries(F.collect_list(F.struct("lang", "k")))
        kept = counts.groupBy("n", "item").agg(each.alias("by"), F.sum("k").alias("all")).where("all > 1")
        kept = kept.select("n", "item", *[F.coalesce(F.col("by")[x], F.lit(0)).cast("int").alias(f"k{i}") for i, x in enumerate(langs)])
        items, logs = [], []
        for n in range(ORDER + 1):
            part = kept.where(F.col("n") == n).drop("n").orderBy("item").toPandas()
            totals = sums[sums["n"] == n].set_index("lang")["k"].reindex(langs, fill_value=0).to_numpy(float)
            items.append({x: k for k, x in enumerate(part["item"])})
            table = part[[f"k{i}" for i in range(len(langs))]].to_numpy(float)
            logs.append(np.log((table + SMOOTHING) / (totals + SMOOTHING * max(1, len(part)))).astype(np.float32))
        return cls(langs, items, logs)

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word that the model doesn't know: the mean over its longest known n-grams."""
        for n in range(ORDER, 0, -1):
            if known := [k for g in grams(word, n) if (k := self.items[n].get(g)) is not None]:
                return self.logs[n][known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def scores(self, distinct: list[str]) -> np.ndarray:
        """One row of scores for each word."""
        at = np.fromiter((self.items[0].get(w, -1) for w in distinct), np.int64, len(distinct))
        out = np.zeros((len(distinct), len(self.langs)), np.float32)
        out[at >= 0] = self.logs[0][at[at >= 0]]
        for k in np.flatnonzero(at < 0).tolist():
            word = distinct[k]
            if (row := self.kept.get(word)) is None:
                out[k] = self.unseen(word)
                if len(word) <= 40:
                    if len(self.kept) >= _KEPT or not len(self.rows):
                        self.kept, self.rows = {}, np.empty((_KEPT, len(self.langs)), np.float32)
                    row = self.kept[word] = len(self.kept)
                    self.rows[row] = out[k]
            else:
                out[k] = self.rows[row]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """For each text the language and its share of the (tempered) posterior; ``und`` and 0 without letters or model."""
        found = [words(x) if x and self.langs else [] for x in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        langs, shares = np.full(len(texts), len(self.langs)), np.zeros(len(texts))
        if sizes.any():
            coded = pa.array([w for own in found for w in own], pa.string()).dictionary_encode()
            each = self.scores(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            some = sizes > 0
            own = sizes[some, None]
            mean = np.add.reduceat(each, np.cumsum(own) - own[:, 0], axis=0, dtype=np.float64) / own * np.minimum(own, EVIDENCE)
            share = np.exp(mean - mean.max(axis=1, keepdims=True))
            langs[some], shares[some] = share.argmax(axis=1), share.max(axis=1) / share.sum(axis=1)
        names = [*self.langs, "und"]
        return [names[k] for k in langs.tolist()], shares.tolist()


def predict(docs: DataFrame, model: BackoffModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from whole texts; columns of these names are replaced.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Equal scores go
    to the first language by code point. Repeated rows are predicted alike. The model is broadcast; the fitting
    sample bounds its size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def run(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in text_slices(text):
            own = sent.value.predict(part.to_pylist())
            langs += own[0]
            scores += own[1]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    # Said not to be deterministic, so that a filter on the result doesn't make Spark predict twice.
    rest = docs.drop("lang_pred", "score")
    found = rest.withColumn("_found", run.asNondeterministic()(F.col("text")))
    return found.select(*rest.columns, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def in_fold(fold: int, folds: int):
    """Whether a row is in this fold, by crc32 of its doc_id as text; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
