"""Tokens of whole Arrow batches of texts, the same as those of ``raw_tokens`` and ``tokenize``: for stages that build arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathomry.functions.text import FNV_PRIME, FNV_START, SPACE, STEM_END, STOP_WORDS

#: About so many bytes of text are held as arrays at once.
SLICE_BYTES = 1 << 21
_TOKEN, _SPACE, _DROPPED = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, _DROPPED, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789_-")] = _TOKEN
_KIND[list(b"\t\n\x0b\x0c\r ")] = _SPACE
#: What isn't ASCII but counts as white space, or has a lower case that is ASCII in part.
_SPACES = "[" + SPACE.removeprefix(r"\t\n\x0b\f\r ") + "]"
_LETTERS = (("İ", "i"), ("K", "k"))
_STEM = re.compile(STEM_END)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in stretches of about SLICE_BYTES or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(ends)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield texts.slice(a, b - a)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _begins(word: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a stretch of ``word`` begins; none spans two texts."""
    out = word.copy()
    out[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(word)]
    out[first] = word[first]
    return np.flatnonzero(out)


def _plain_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, where white space and lower cases that are ASCII in part are ASCII, and the texts' ends."""
    texts = texts.fill_null("")
    data, ends = _bytes(texts)
    if len(data) and data.max() >= 128:
        texts = pc.replace_substring_regex(texts, _SPACES, " ")
        for letter, ascii_ in _LETTERS:
            texts = pc.replace_substring(texts, letter, ascii_)
        data, ends = _bytes(texts)
    return data, ends


def word_counts(texts: pa.Array) -> np.ndarray:
    """``word_count`` of each text."""
    data, ends = _plain_bytes(texts)
    return np.bincount(np.searchsorted(ends, _begins(_KIND[data] != _SPACE, ends), side="right") - 1, minlength=len(texts))


def distinct_counts(lists: pa.Array) -> np.ndarray:
    """How many different values each list of strings has."""
    code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    most = int(code.max(initial=0)) + 1
    return np.bincount(np.unique(row * most + code) // most, minlength=len(lists))


def raw_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens that aren't empty (ASCII, binary), the row of each, and ``token_count`` of each row."""
    data, ends = _plain_bytes(texts)
    kind = _KIND[_LOWER[data]]
    runs = np.bincount(np.searchsorted(ends, _begins(kind == _SPACE, ends), side="right") - 1, minlength=len(texts))
    kept = kind != _DROPPED
    upto = np.concatenate([[0], np.cumsum(kept)])
    data, kind, ends = _LOWER[data[kept]], kind[kept], upto[ends]
    word = kind == _TOKEN
    at = _begins(word, ends)
    done = np.cumsum(word)
    offsets = np.append(done[at] - 1, done[-1] if len(done) else 0).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    return tokens, np.searchsorted(ends, at, side="right") - 1, runs + 1


def terms(texts: pa.Array, stemmed: bool = False) -> tuple[pa.Array, np.ndarray]:
    """``tokenize`` of each text, with ``stem`` if asked for, as lists of strings; and ``token_count`` of each."""
    tokens, row, counts = raw_tokens(texts)
    coded = tokens.dictionary_encode()
    names, at = coded.dictionary.cast(pa.string()).to_pylist(), coded.indices.to_numpy()
    stop = set(STOP_WORDS)
    kept = np.fromiter((len(x) > 1 and x not in stop for x in names), bool, len(names))[at]
    names = [_STEM.sub("", x) if len(x) > 4 else x for x in names] if stemmed else names
    found = pa.array(names, pa.string()).take(pa.array(at[kept]))
    ends = np.searchsorted(row[kept], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), found), counts


def fnv1a(tokens: pa.Array, seed: str = "") -> np.ndarray:
    """FNV-1a of ``seed`` (ASCII) and each token."""
    data, ends = _bytes(tokens)
    start = FNV_START
    for c in seed.encode():
        start = ((start ^ c) * FNV_PRIME) % (1 << 32)
    out, size = np.full(len(tokens), start, np.uint64), np.diff(ends)
    left, k = np.flatnonzero(size > 0), 0
    while len(left):
        out[left] = ((out[left] ^ data[ends[left] + k]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        k += 1
        left = left[size[left] > k]
    return out
