"""BPE encoding and decoding by a pair-occurrence index.

Texts are normalised and cut at white space; each partition keeps the distinct pieces it has met. All
unseen pieces of a batch are encoded together: one index maps each mergeable pair to all the positions where
it occurs, the active ranks are applied in ascending order, each to all its positions at once, and the lists
of the pairs to the left and right of a merge are updated. No shuffle is needed and the work is linear in the
text, whatever the length of a document or of a piece. Letters that Unicode added after the tokenizer library's
tables may be cut otherwise than the library cuts them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the tokenizer's ``\s`` has it. Fixed values.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{SPACES}]+")
#: str.split() also cuts at these, which the tokenizer takes for symbols.
_SEPARATORS = re.compile("[\x1c-\x1f]")

#: Distinct pieces that a task keeps; beyond it the cache starts anew. Changes time and memory, never results.
CACHE_PIECES = 250_000
#: Rows and characters of text that are encoded together.
BATCH_ROWS, BATCH_CHARS = 1_000, 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def gathered(values: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at these slots of a ragged array, one after the other, and where each ends."""
    size = ends[slots + 1] - ends[slots]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(out[-1]) + np.repeat(ends[slots] - out[:-1], size)], out


class PairIndexBpe:
    """Encodes and decodes with one tokenizer file (JSON with NFC, lower-casing, a split pattern and byte-level BPE)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], dtype=np.int64)
        self.rank: dict[int, int] = {}
        parts = []
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = vocab[left], vocab[right]
            self.rank[a << 32 | b] = rank
            parts.append((a, b, vocab[left + right]))
        self.parts = np.array(parts, dtype=np.int64).reshape(-1, 3)
        tokens = vocab | self.special
        names = [""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            names[i] = token
        self.tokens = pa.array(names, pa.large_string())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.slot: dict = {t: k for k, t in enumerate((s, i) for s, i in self.special.items())}
        self.ids = np.array(list(self.special.values()), dtype=np.int32)
        self.ends = np.arange(len(self.special) + 1, dtype=np.int64)

    def pieces(self, text: str) -> list:
        """White-space pieces of the normalised text; a special token is a pair (text, id)."""
        if self.cut and "<" in text and self.cut.search(text):
            out = []
            for k, part in enumerate(self.cut.split(text)):
                out += [(part, self.special[part])] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # A final sigma depends on its neighbours only in str.lower().
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if _SEPARATORS.search(text):
            return [x for x in _SPLIT.split(text) if x]
        return text.split()

    def words(self, piece: str) -> list[str]:
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def learn(self, unseen: list[str]) -> None:
        """Encode pieces that the cache lacks and add them to it."""
        words = [self.words(x) for x in unseen]
        index = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        known, counts = self.merge([w.encode() for w in index])
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64)
        ids, ends = gathered(known, np.concatenate([[0], np.cumsum(counts)]), at)
        ends = ends[np.cumsum([0, *map(len, words)])]
        base = len(self.slot)
        self.slot.update((x, base + k) for k, x in enumerate(unseen))
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each word has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw, last = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - 1
        sym = self.inner[raw]
        sym[last] = self.last[raw[last]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = -1
        before[last[:-1] + 1] = -1

        at: dict[int, list[np.ndarray]] = {}  # rank -> positions of its pair's left part
        active: list[int] = []

        def note(left: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            if not len(left):
                return
            ranks = np.fromiter(map(self.rank.get, (sym[left] << 32 | sym[after[left]]).tolist(), repeat(-1)), np.int64, len(left))
            left, ranks = left[ranks >= 0], ranks[ranks >= 0]
            if not len(left):
                return
            order = np.argsort(ranks, kind="stable")
            left, ranks = left[order], ranks[order]
            starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            for r, own in zip(ranks[starts].tolist(), np.split(left, starts[1:]), strict=True):
                if r not in at:
                    at[r] = []
                    heapq.heappush(active, r)
                at[r].append(own)

        note(np.flatnonzero(after >= 0))
        alive = np.ones(n, bool)
        while active:
            a, b, merged = self.parts[r := heapq.heappop(active)]
            lists = at.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[alive[p] & (sym[p] == a) & (after[p] >= 0)]
            p = p[sym[after[p]] == b]
            if a == b and len(p) > 1:  # in a run of one symbol, every second position, from the left
                chained = np.concatenate([[False], after[p[:-1]] == p[1:]])
                k = np.arange(len(p))
                p = p[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            sym[p], alive[q] = merged, False
            after[p] = nxt = after[q]
            before[nxt[nxt >= 0]] = p[nxt >= 0]
            left = before[p]
            note(np.unique(np.concatenate([left[left >= 0], p[nxt >= 0]])))
        return sym[alive], np.add.reduceat(alive.astype(np.int64), last - lengths + 1)

    def encode(self, texts: list[str]) -> pa.LargeListArray:
        pieces = [self.pieces(x) for x in texts]
        if unseen := list(set().union(*pieces) - self.slot.keys()):
            if len(self.slot) + len(unseen) > CACHE_PIECES:
                self.forget()
                unseen = list(set().union(*pieces) - self.slot.keys())
            self.learn(unseen)
        slots = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(pieces)), np.int64)
        ids, ends = gathered(self.ids, self.ends, slots)
        return pa.LargeListArray.from_arrays(pa.array(ends[np.cumsum([0, *map(len, pieces)])]), pa.array(ids))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Each list's token strings, joined by one space (the tokenizer file has no decoder). Null for null."""
        names = self.tokens.take(pc.list_flatten(ids))
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), names), pa.scalar(" ", names.type))
        return pc.if_else(pc.is_valid(ids), joined, pa.scalar(None, joined.type))


_loaded: dict[int, PairIndexBpe] = {}


def _tokenizer(spec) -> PairIndexBpe:
    """One tokenizer per Python worker, kept from task to task."""
    if (key := hash(spec.value)) not in _loaded:
        _loaded.clear()
        _loaded[key] = PairIndexBpe(spec.value)
    return _loaded[key]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of at most BATCH_ROWS values, cut where BATCH_CHARS are reached: first row and values."""
    for start in range(0, len(column), BATCH_ROWS):
        values = [x or "" for x in column.slice(start, BATCH_ROWS).to_pylist()]
        first = chars = 0
        for k, x in enumerate(values):
            chars += len(x)
            if chars >= BATCH_CHARS or k == len(values) - 1:
                yield start + first, values[first : k + 1]
                first, chars = k + 1, 0


def _mapped(df: DataFrame, column: str, made: dict[str, T.DataType], work) -> DataFrame:
    """``df`` with the columns that ``work`` makes from ``column``, by Arrow batches, without a shuffle."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in made] + [T.StructField(n, kind) for n, kind in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n not in made]
            for start, *out in work(batch.column(column)):
                part = batch.slice(start, len(out[0]))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + out, names=[*keep, *made])

    return df.mapInArrow(run, schema)


def _spec(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of whole texts in ``out`` (array<int>), special tokens recognised and none added.

    Null and empty texts have no ids (an empty array). A column of ``docs`` named ``out`` is replaced; repeated
    rows are encoded alike. ``path`` is the tokenizer file on the driver; it is sent to the executors (under 2 MB).
    """
    spec = _spec(docs, path)

    def work(column: pa.Array):
        for start, texts in _parts(column):
            yield start, _tokenizer(spec).encode(texts).cast(pa.list_(pa.int32()))

    return _mapped(docs, text, {out: T.ArrayType(T.IntegerType())}, work)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of each id list in ``out``; null lists give null, empty ones an empty text."""
    spec = _spec(encoded, path)

    def work(column: pa.Array):
        for start in range(0, len(column), BATCH_ROWS):
            yield start, _tokenizer(spec).decode(column.slice(start, BATCH_ROWS)).cast(pa.string())

    return _mapped(encoded, ids, {out: T.StringType()}, work)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of the ids in one pass: ``docs`` with ``ids`` and ``decoded``, by the rules of both."""
    spec = _spec(docs, path)

    def work(column: pa.Array):
        for start, texts in _parts(column):
            ids = _tokenizer(spec).encode(texts).cast(pa.list_(pa.int32()))
            yield start, ids, _tokenizer(spec).decode(ids).cast(pa.string())

    return _mapped(docs, text, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, work)


def digests(decoded: DataFrame) -> DataFrame:
    """Token counts and SHA-256 digests of ids and decoded texts (columns ``ids`` and ``decoded``)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
