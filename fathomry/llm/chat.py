"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered as canonical turns.

The hidden state of a line is the role that speaks; a line either goes on with the turn or begins one. Emissions are
the line's speaker marker and features such as its length and ending. Transitions between turns and the features'
frequencies come from a bounded sample of labelled rows.

Viterbi runs over whole conversations of any length without gathering one in a task. A row's lines are summed up
in a small matrix: the best score for each role that begins the row and each that ends it. Thin rows (no
text) are range-sorted, cut into blocks, and each block's matrix product gives its best score between any two roles.
A scan over the blocks fixes the roles at their ends, a second pass the roles of each row, a third those of its lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomry.llm.common import small_side, stored

#: What speakers are called. Fixed values.
ALIASES = {
    "user": "user", "human": "user", "customer": "user", "client": "user", "question": "user", "q": "user", "me": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant", "gpt": "assistant",
    "system": "system", "instruction": "system", "instructions": "system", "sys": "system",
}
_MARKER = re.compile(r"^\s*(?:[#*>\[(_|<-]+\s*)*(" + "|".join(sorted(ALIASES, key=len, reverse=True)) + r")\s*(?:\d{1,6}\s*)?(?:[\])*_|>]*\s*:\s*[*_]*|\s*[\]|>]+)\s*", re.IGNORECASE)
_LISTED = re.compile(r"^\s*(?:[-*+•]\s|\d{1,9}[.)]\s|```|\|)")
#: Rows of a block of the Viterbi scan.
BLOCK_ROWS = 2_048
#: Labelled rows that the model is fitted on, about (a hash of the conversation picks them), and the first rows used of each.
SAMPLE_ROWS, SAMPLE_TURNS = 50_000, 64
#: Chances: a turn begins inside a row; a beginning has a marker, or another role's; a line that goes on looks like one.
BEGIN_INSIDE, MARKED, MISMARKED, SEEMING = 0.02, 0.45, 0.0001, 0.0001
#: Added to the count of every line feature.
SMOOTHING = 5.0


def lines_of(text: str | None) -> list[str]:
    """The lines that hold more than white space."""
    return [x for x in (text or "").splitlines() if x.strip()]


def marker(line: str) -> str | None:
    """The role that a speaker marker at the line's start names."""
    found = _MARKER.match(line)
    return ALIASES[found[1].lower()] if found else None


def without_marker(line: str) -> str:
    return line[found.end() :] if (found := _MARKER.match(line)) else line


def features(line: str) -> str:
    """Length class, ending and shape of a line, as a code."""
    x = line.strip()
    return f"{min(len(x), 65_535).bit_length()}{'?' if x.endswith('?') else '.' if x[-1:] in '.!' else ','}{'-' if _LISTED.match(line) else ' '}"


class TurnModel:
    """Log scores of the hidden Markov model."""

    def __init__(self, starts: dict[str, int], moves: dict[tuple[str, str], int], seen: dict[tuple[str, bool, str], int]):
        """Counts of first roles, of roles that follow each other, and of features by role and whether the line is a row's first."""
        self.roles = sorted({*ALIASES.values(), *starts, *(r for pair in moves for r in pair)})
        n = len(self.roles)
        own = np.array([starts.get(r, 0) + 0.5 for r in self.roles])
        self.start = np.log(own / own.sum())
        turns = np.array([[moves.get((a, b), 0) + 0.5 for b in self.roles] for a in self.roles])
        self.move = np.log(turns / turns.sum(axis=1, keepdims=True))
        codes = {code for _, _, code in seen}
        self.codes = {}
        for first in (True, False):
            totals = np.array([sum(k for (r, f, _), k in seen.items() if r == role and f == first) for role in self.roles])
            self.codes[first] = {code: np.log([(seen.get((r, first, code), 0) + SMOOTHING) / (t + SMOOTHING * (len(codes) + 1)) for r, t in zip(self.roles, totals, strict=True)]) for code in codes}
            self.codes[first][None] = np.log(SMOOTHING / (totals + SMOOTHING * (len(codes) + 1)))
        self.begin = {None: np.full(n, np.log(1 - MARKED - MISMARKED))} | {m: np.log([MARKED if r == m else MISMARKED / (n - 1) for r in self.roles]) for m in set(ALIASES.values())}

    def emissions(self, line: str, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores by role if the line begins a turn, and if it goes on with one."""
        named, shape = marker(line), self.codes[first]
        own = shape.get(features(line) if named is None else features(without_marker(line)), shape[None])
        return own + self.begin[named], own + np.log(SEEMING if named else 1 - SEEMING)

    def matrix(self, lines: list[str]) -> np.ndarray:
        """The best score of a row's lines for each role of its first line and of its last."""
        n = len(self.roles)
        w = np.full((n, n), -np.inf)
        w[np.arange(n), np.arange(n)] = self.emissions(lines[0], True)[0]
        for line in lines[1:]:
            begins, goes = self.emissions(line, False)
            w = np.maximum(w + np.log(1 - BEGIN_INSIDE) + goes, (w[:, :, None] + self.move).max(axis=1) + np.log(BEGIN_INSIDE) + begins)
        return w

    def turns(self, lines: list[str], first: int, last: int) -> list[tuple[int, bool]]:
        """The best role of each line, and whether it begins a turn, given the roles of the first and the last line."""
        n = len(self.roles)
        score = np.full(n, -np.inf)
        score[first] = 0.0
        steps = []
        for line in lines[1:]:
            begins, goes = self.emissions(line, False)
            moved = score[:, None] + self.move
            before = moved.argmax(axis=0)
            new, same = moved[before, np.arange(n)] + np.log(BEGIN_INSIDE) + begins, score + np.log(1 - BEGIN_INSIDE) + goes
            steps.append((new > same, np.where(new > same, before, np.arange(n))))
            score = np.maximum(new, same)
        out, role = [], last
        for new, before in reversed(steps):
            out.append((role, bool(new[role])))
            role = int(before[role])
        return [(first, True), *reversed(out)]


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TurnModel:
    """Fit on about ``sample_rows`` rows (conv_id, turn, role, text) of conversations that a hash picks, the first SAMPLE_TURNS rows of each.

    Rows with a null in conv_id, turn or role are left out; null and empty texts count for the order of roles only. Turns are
    taken in order, wherever their numbers begin and whatever is missing between them; of several rows of one turn
    the smallest role counts as its own. What comes to the driver are counts by role and code of that sample.
    """
    rows = rows.where("conv_id is not null and turn is not null and role is not null").select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rate = min(1.0, sample_rows / max(1, rows.count()))
    share = F.pmod(F.xxhash64("conv", F.lit("chat")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    in_order = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", F.xxhash64("text")))
    sample = stored(rows.where(share < rate).withColumn("n", in_order).where(F.col("n") <= SAMPLE_TURNS), "sample")
    by_turn = Window.partitionBy("conv").orderBy("turn")
    roles = sample.groupBy("conv", "turn").agg(F.min("role").alias("role"))
    steps = roles.select("role", F.lead("role").over(by_turn).alias("next"), (F.row_number().over(by_turn) == 1).alias("first"))
    starts, moves = Counter(), Counter()
    for r in steps.groupBy("role", "next", "first").count().collect():
        starts[r["role"]] += r["count"] if r["first"] else 0
        moves[r["role"], r["next"]] += r["count"] if r["next"] is not None else 0
    moves = {pair: n for pair, n in moves.items() if n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(role, k == 0, features(without_marker(x))) for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, x in enumerate(lines_of(text))]
            role, first, code = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(role, pa.string()), pa.array(first, pa.bool_()), pa.array(code, pa.string())], names=["role", "first", "code"])

    seen = sample.select("role", "text").mapInArrow(run, "role string, first boolean, code string").groupBy("role", "first", "code").count().collect()
    return TurnModel(starts, moves, {(r["role"], r["first"], r["code"]): r["count"] for r in seen})


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _entered(model: TurnModel, w: np.ndarray) -> np.ndarray:
    """From the role before a row to the role at its end; the last row of it stands for a conversation's start."""
    return _product(np.vstack([model.move, model.start]), w)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by runs of equal keys, across batches."""
    rows = (r for b in batches for r in b.to_pylist())
    for key, run in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, run


def _blocks(thin: DataFrame, sent) -> DataFrame:
    """conv, turn, digest, w with block and pos of the range-sorted rows; and, with pos -1, each block's matrix."""
    n = len(sent.value.roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, block = sent.value, TaskContext.get().partitionId() << 32
        names = ["conv", "turn", "digest", "w", "block", "pos"]
        out: list[tuple] = []

        def cut() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for (conv,), rows in _runs(batches, "conv"):
            total, pos = None, 0
            for r in rows:
                w = _entered(model, np.array(r["w"]).reshape(n, n))
                total = w if total is None else _product(total, w[:n])
                out.append((conv, r["turn"], r["digest"], r["w"], block, pos))
                pos += 1
                if pos == BLOCK_ROWS:
                    out.append((conv, None, None, total.ravel().tolist(), block, -1))
                    total, pos, block = None, 0, block + 1
            if pos:
                out.append((conv, None, None, total.ravel().tolist(), block, -1))
                block += 1
            if len(out) >= 4_096:
                yield cut()
        if out:
            yield cut()

    by = ["conv", "turn", "digest"]
    return thin.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "conv string, turn long, digest string, w array<double>, block long, pos int")


def _best_path(start: int, matrices: list[np.ndarray]) -> list[int]:
    """The states after each matrix on the best path from ``start``."""
    score, back = None, []
    for m in matrices:
        if score is None:
            back.append(np.full(m.shape[1], start))
            score = m[start]
        else:
            through = score[:, None] + m
            back.append(through.argmax(axis=0))
            score = through.max(axis=0)
    states = [int(score.argmax())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _ends(blocks: DataFrame, sent) -> DataFrame:
    """block, entry and exit: the roles at the ends of each block on its conversation's best path."""
    n = len(sent.value.roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, entries, exits = [], [], []
        for _, rows in _runs(batches, "conv"):
            rows = list(rows)  # one for BLOCK_ROWS rows of the conversation
            all_of = [np.array(r["w"]).reshape(n + 1, n) for r in rows]
            path = _best_path(n, [all_of[0], *(m[:n] for m in all_of[1:])])
            ids += [r["block"] for r in rows]
            entries += [n, *path[:-1]]
            exits += path
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(entries, pa.int32()), pa.array(exits, pa.int32())], names=["block", "entry", "exit"])

    return blocks.repartition("conv").sortWithinPartitions("conv", "block").select("conv", "block", "w").mapInArrow(run, "block long, entry int, exit int")


def _row_roles(rows: DataFrame, sent) -> DataFrame:
    """conv, turn, digest, first, last: the roles of each row's first and last line, from its block's ends."""
    n = len(sent.value.roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = sent.value, []
        enter = np.vstack([model.move, model.start])

        def cut() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", "turn", "digest", "first", "last"])

        for _, own in _runs(batches, "block"):
            own = list(own)  # at most BLOCK_ROWS
            ws = [np.array(r["w"]).reshape(n, n) for r in own]
            steps = [_entered(model, w) for w in ws]
            steps = [steps[0], *(s[:n] for s in steps[1:])]
            end = np.full(n, -np.inf)
            end[own[0]["exit"]] = 0.0
            steps[-1] = steps[-1] + end
            before = own[0]["entry"]
            for r, w, last in zip(own, ws, _best_path(before, steps), strict=True):
                out.append((r["conv"], r["turn"], r["digest"], int((enter[before] + w[:, last]).argmax()), last))
                before = last
            if len(out) >= 4_096:
                yield cut()
        yield cut()

    return rows.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(run, "conv string, turn long, digest string, first int, last int")


def parse(rows: DataFrame, model: TurnModel) -> DataFrame:
    """The turns of transcripts: conv_id, turn, part, role, content, rendered (one row for each turn recovered).

    ``rows`` (conv_id, turn, text) are a conversation's pieces in the order of ``turn`` (nulls first; pieces of one turn by
    their text's digest); each begins a turn and may hold further ones, which ``part`` numbers from 0. ``content`` is the
    turn's lines without their speaker marker and without blank lines, ``rendered`` the same between role tags. A
    null or blank text has no line: it takes no part in the path and gives one row with part 0 and null role, content and
    rendered. A row without conv_id is a conversation of its own. Repeated rows count once in the path and each get the
    result. Only these three columns are read, so that others (a role, say) don't matter. An empty table gives
    an empty result.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.concat(F.lit("?"), digest, F.col("turn").cast("string")), F.concat(F.lit("?"), digest))
    rows = rows.select("conv_id", "turn", "text", conv.alias("conv"), F.col("turn").cast("long").alias("_turn"), digest.alias("digest"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.matrix(x).ravel().tolist() if (x := lines_of(t)) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("digest"), pa.array(found, pa.list_(pa.float64()))], names=["conv", "turn", "digest", "w"])

    thin = rows.select("conv", F.col("_turn").alias("turn"), "digest", "text").mapInArrow(matrices, "conv string, turn long, digest string, w array<double>")
    thin = stored(thin.where("w is not null").groupBy("conv", "turn", "digest").agg(F.first("w").alias("w")), "rows")
    blocks = stored(_blocks(thin, sent), "blocks")
    ends = stored(_ends(blocks.where("pos = -1"), sent), "ends")
    roles = stored(_row_roles(blocks.where("pos >= 0").join(small_side(ends), "block"), sent), "roles")

    kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at, out = [], []
            for k, (text, first, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "first", "last")), strict=True)):
                if first is None:
                    at.append(k)
                    out.append((0, None, None, None))
                    continue
                lines, part = lines_of(text), -1
                spoken: list[tuple[str, list[str]]] = []
                for line, (role, begins) in zip(lines, own.turns(lines, first, last), strict=True):
                    if begins:
                        spoken.append((own.roles[role], []))
                    spoken[-1][1].append(without_marker(line).rstrip() if begins else line.rstrip())
                for part, (role, own_lines) in enumerate(spoken):
                    content = "\n".join(x for x in own_lines if x.strip())
                    at.append(k)
                    out.append((part, role, content, f"<|{role}|>\n{content}\n<|end|>\n"))
            part, role, content, rendered = zip(*out, strict=True) if out else ((), (), (), ())
            ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("conv_id", "turn")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(part, pa.int32()), pa.array(role, pa.string()), pa.array(content, pa.string()), pa.array(rendered, pa.string())], names=["conv_id", "turn", "part", "role", "content", "rendered"])

    roles = roles.select(F.col("conv").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("digest").alias("r_digest"), "first", "last")
    same = (F.col("conv") == F.col("r_conv")) & F.col("_turn").eqNullSafe(F.col("r_turn")) & (F.col("digest") == F.col("r_digest"))
    whole = rows.join(small_side(roles), same, "left").select("conv_id", "turn", "text", "first", "last")
    return whole.mapInArrow(render, f"conv_id {kind[0]}, turn {kind[1]}, part int, role string, content string, rendered string")
