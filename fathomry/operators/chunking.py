"""Chunkers: from documents to chunk rows.

Windows and paragraph chunks are plain expressions. The others fold over a document's sentences, one after the other,
and are small Python helpers under an Arrow UDF; Spark deals the documents out.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from bisect import bisect_right
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions.text import marked_headings, normalize_text, sentences, token_count, word_count

SIZE, OVERLAP = 500, 50
LAB_SIZE, REFERENCE_CHARS = 450, 320
#: Overlap of a preview's sentence windows as a share of their size; words that an answer may use.
PREVIEW_OVERLAP, PREVIEW_BUDGET = 0.15, 120
_REFERENCE = re.compile(r"Section (\d+(?:\.\d+)+)")
_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
_CHUNK = "array<struct<start:int,end:int,text:string,words:int,prov:int,refs:array<int>,first_unit:int,end_unit:int,gap:boolean,home:int,mentions:array<string>>>"


# --- windows and paragraphs: expressions -----------------------------------------------------------------------------


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Fixed windows as array<struct<start, end, text>>; blank ones are left out, and none starts after the end is reached."""
    step = max(1, size - overlap)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end"), F.substring(text, s + 1, F.lit(size)).alias("text"))
    return F.filter(F.transform(starts, cut), lambda c: c["text"].rlike(r"\S"))


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no, start, end, text, words: fixed windows of each document (doc_id, text)."""
    out = docs.select("doc_id", F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk_no", "c"))
    return out.select("doc_id", "chunk_no", "c.start", "c.end", "c.text", word_count(F.col("c.text")).alias("words"))


def rendered(docs: DataFrame) -> DataFrame:
    """doc_id, title, text, heads: a structured document (doc_id, title, sections<id, title, paras>) as one text.

    ``heads`` has the position at which each section starts, for as-of lookups.
    """
    part = lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), F.array_join(s["paras"], "\n\n"))
    parts = docs.withColumn("parts", F.transform("sections", part))
    sizes = F.transform("parts", lambda p: F.length(p) + 2)
    heads = F.transform("sections", lambda s, k: F.struct(F.aggregate(F.slice("sizes", 1, k), F.lit(0), lambda a, x: a + x).alias("start"), s["id"].alias("section")))
    return parts.withColumn("sizes", sizes).select("doc_id", "title", F.array_join("parts", "\n\n").alias("text"), heads.alias("heads"))


def section_windows(docs: DataFrame, size: int = 400) -> DataFrame:
    """Non-overlapping windows of rendered documents, each with the last section that starts at or before it."""
    rows = rendered(docs).select("doc_id", "heads", F.posexplode(windows(F.col("text"), size, 0)).alias("pos", "c"))
    last = F.element_at(F.filter("heads", lambda h: h["start"] <= F.col("c.start")), -1)
    return rows.select("doc_id", "pos", last["section"].alias("section"), "c.text")


def stable_chunks(docs: DataFrame) -> DataFrame:
    """One chunk for each paragraph, under its document's and section's titles: doc_id, pos, section, text."""
    rows = docs.select("doc_id", "title", F.posexplode("sections").alias("sno", "s")).select("doc_id", "title", "sno", "s.id", F.col("s.title").alias("head"), F.posexplode("s.paras").alias("pno", "para"))
    text = F.concat("title", F.lit(" › "), "head", F.lit("\n"), "para")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("sno", "pno")) - 1
    return rows.select("doc_id", pos.alias("pos"), F.col("id").alias("section"), text.alias("text"))


# --- sentence packing ------------------------------------------------------------------------------------------------


def pack(parts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sentences in chunks of about ``size`` characters; whole sentences of at most ``overlap`` are carried over."""
    out, held, length = [], [], 0  # length of the joined text, a carried overlap's closing space included
    for s in parts:
        if held and length + 1 + len(s) > size:
            out.append(" ".join(held).strip())
            back, room = [], 0
            for old in filter(None, reversed(held)):
                if room + 1 + len(old) > overlap:
                    break
                back.insert(0, old)
                room += 1 + len(old)
            # What is carried over ends with a space of its own.
            held, length = ([*back, ""], room) if back else ([], 0)
        length += len(s) + bool(held)
        held.append(s)
    if any(held):
        out.append(" ".join(held).strip())
    return [x for x in out if x]


def _packed(size: int, overlap: int):
    @F.pandas_udf("array<string>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([pack(list(p), size, overlap) for p in parts])

    return run


def sentence_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, page, chunk_no (over the document's pages), text, n_tokens from pages (doc_id, page, text), normalised first."""
    parts = sentences(normalize_text(F.col("text")))
    rows = pages.select("doc_id", "page", F.posexplode(_packed(size, overlap)(parts)).alias("k", "text"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "k")) - 1
    return rows.select("doc_id", "page", no.alias("chunk_no"), "text", token_count(F.col("text")).alias("n_tokens"))


# --- documents with structure ----------------------------------------------------------------------------------------


def sentence_spans(line: str) -> list[tuple[int, int]]:
    """Sentences of a line as offsets; they end at . ! ? before white space or the line's end."""
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)", line):
        if line[start : m.end()].strip():
            lead = len(line[start : m.end()]) - len(line[start : m.end()].lstrip())
            out.append((start + lead, m.end()))
        start = m.end()
    if line[start:].strip():
        rest = line[start:]
        out.append((start + len(rest) - len(rest.lstrip()), start + len(rest.rstrip())))
    return out


@lru_cache(maxsize=1)
def parse(text: str) -> tuple[str, list[dict], list[dict]]:
    """A markdown document's text, units (headings and sentences, with offsets) and provisions (numbered or deep headings).

    The last document's are kept, for all strategies that look at it; callers don't change them.
    """
    text = text.replace("\r\n", "\n")
    units: list[dict] = []
    provisions: list[dict] = []
    stack: list[tuple[int, str]] = []
    current, at = None, 0
    for line in text.split("\n"):
        if found := _HEADING.match(line):
            level, title = len(found[1]), found[2].strip()
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            number = re.match(r"\d+(?:\.\d+)*", title)
            name = number[0] if number else ""
            unit = {"start": at, "end": at + len(line), "type": "heading", "level": level, "text": line}
            if level >= 3 or "." in name:
                current = len(provisions)
                rest = title[len(name) :].lstrip(". ").strip() if name else title
                provisions.append({"id": name, "title": rest, "path": [t for d, t in stack[:-1] if d > 1] + [title], "units": [len(units)], "start": at, "end": at + len(line)})
            else:
                current = None
            units.append(unit | {"prov": current})
        else:
            for a, b in sentence_spans(line):
                if current is not None:
                    provisions[current]["units"].append(len(units))
                    provisions[current]["end"] = at + b
                units.append({"start": at + a, "end": at + b, "type": "sentence", "level": None, "text": line[a:b], "prov": current})
        at += len(line) + 1
    return text, units, provisions


def _chunk(source: str, start: int, end: int, **more) -> dict:
    own = {"start": start, "end": end, "text": source[start:end], "prov": None, "refs": None, "first_unit": None, "end_unit": None, "gap": None} | more
    return own | {"words": len(own["text"].split())}


def lab_windows(text: str, size: int = LAB_SIZE, overlap: int = OVERLAP) -> list[dict]:
    text = text.replace("\r\n", "\n")
    step, out = max(1, size - overlap), []
    for start in range(0, len(text), step):
        end = min(len(text), start + size)
        if text[start:end].strip():
            out.append(_chunk(text, start, end))
        if end == len(text):
            break
    return out


def lab_sentences(text: str, size: int = LAB_SIZE, overlap: int = OVERLAP) -> list[dict]:
    """Units packed by their source span; a chunk starts again with the units at the end of the one before, up to ``overlap``."""
    text, units, _ = parse(text)
    out, first = [], 0
    for k, unit in enumerate(units):
        if k > first and unit["end"] - units[first]["start"] > size:
            last = units[k - 1]["end"]
            out.append(_chunk(text, units[first]["start"], last))
            while first < k and last - units[first]["start"] > overlap:
                first += 1
    if units:
        out.append(_chunk(text, units[first]["start"], units[-1]["end"]))
    return out


def lab_structure(text: str, size: int = LAB_SIZE, references: bool = True, reference_chars: int = REFERENCE_CHARS) -> list[dict]:
    """Chunks of one provision each under its heading path, followed by the provisions that it refers to."""
    text, units, provisions = parse(text)
    numbered = {p["id"]: k for k, p in enumerate(provisions)}

    def body(p: dict) -> str:
        held = ""
        for u in p["units"][1:]:
            longer = f"{held} {units[u]['text']}" if held else units[u]["text"]
            if held and len(longer) > reference_chars:
                break
            held = longer
        return held

    out = []
    for k, p in enumerate(provisions):
        pieces: list[list[int]] = [[]]
        for u in p["units"][1:]:
            if pieces[-1] and units[u]["end"] - units[pieces[-1][0]]["start"] > size:
                pieces.append([])
            pieces[-1].append(u)
        head = units[p["units"][0]]
        for no, piece in enumerate(pieces):
            start = units[piece[0]]["start"] if no else head["start"]
            end = units[piece[-1]]["end"] if piece else head["end"]
            cited = dict.fromkeys(numbered[x] for x in _REFERENCE.findall(text[start:end]) if x in numbered and numbered[x] != k) if references else {}
            shown = "".join(f"\n↳ Section {provisions[c]['id']} {provisions[c]['title']}: {body(provisions[c])}" for c in cited)
            own = " ".join(units[u]["text"] for u in piece)
            out.append(_chunk(text, start, end, text=f"[{' › '.join(p['path'])}]\n{own}{shown}", prov=k, refs=list(cited)))
    return out


def located(text: str, units: list[dict], questions: list[list[str]]) -> list[list[tuple[int, int]]]:
    """For each question the first and last unit of each evidence text that the document holds verbatim."""
    starts = [u["start"] for u in units]
    unit = lambda pos: max(0, bisect_right(starts, pos) - 1)
    return [[(unit(at), unit(at + len(e) - 1)) for e in own if e and (at := text.find(e)) >= 0] for own in questions]


def lab_segments(text: str, questions: list[list[str]], size: int = LAB_SIZE, penalty: float = 0.05) -> list[dict]:
    """The segmentation into spans of at most ``size`` that holds the most evidence together (dynamic programme).

    A segment earns 1 for each evidence span and 1 for each question of several spans that lies inside it, less a penalty.
    Of equal cuts the latest wins.
    """
    text, units, _ = parse(text)
    wanted = [q for q in located(text, units, questions) if q]
    spans = [s for q in wanted for s in q]
    whole = [(min(a for a, _ in q), max(b for _, b in q)) for q in wanted if len(q) > 1]
    ending: dict[int, list[int]] = {}
    for a, b in spans + whole:
        ending.setdefault(b, []).append(a)
    best, cut = [0.0], [-1]
    for i in range(1, len(units) + 1):
        best.append(float("-inf"))
        cut.append(-1)
        for j in range(i - 1, -1, -1):
            if j < i - 1 and units[i - 1]["end"] - units[j]["start"] > size:
                break
            inside = sum(1 for b in range(j, i) for a in ending.get(b, ()) if a >= j)
            value = best[j] + inside - penalty
            if value > best[i]:
                best[i], cut[i] = value, j
    out, i = [], len(units)
    while i > 0:
        j = cut[i]
        out.append(_chunk(text, units[j]["start"], units[i - 1]["end"], first_unit=j, end_unit=i))
        i = j
    return out[::-1]


def lab_overlapping(text: str, questions: list[list[str]], size: int = LAB_SIZE, budget: float = 1.35, alpha: float = 0.02, least: float = 0.5) -> list[dict]:
    """Windows chosen by gain for their length until ``budget`` times the text is spent; gaps are packed afterwards.

    Gain: 1 for each evidence span, 1 for each question of several spans, ``alpha`` for each unit not covered yet.
    """
    text, units, _ = parse(text)
    n = len(units)
    wanted = [q for q in located(text, units, questions) if q]
    goals = {("span", k): s for k, s in enumerate(s for q in wanted for s in q)}
    goals |= {("all", k): (min(a for a, _ in q), max(b for _, b in q)) for k, q in enumerate(wanted) if len(q) > 1}
    windows_of: list[tuple[int, int, int]] = []
    for j in range(n):
        for i in range(j + 1, n + 1):
            cost = units[i - 1]["end"] - units[j]["start"]
            if cost > size and i > j + 1:
                break
            if cost >= least * size or i == n:
                windows_of.append((j, i, max(cost, 1)))
    covered, spent, chosen = [False] * n, 0, []

    def ratio(k: int) -> float:
        j, i, cost = windows_of[k]
        return (sum(1 for a, b in goals.values() if a >= j and b < i) + alpha * covered[j:i].count(False)) / cost

    # Gains only fall, so that a window whose gain is still the best after it is counted anew is the best of all.
    heap = [(-ratio(k), k) for k in range(len(windows_of))]
    heapify(heap)
    while heap:
        _, k = heappop(heap)
        j, i, cost = windows_of[k]
        if spent + cost > budget * len(text):
            continue
        now = (-ratio(k), k)
        if now[0] >= 0:
            continue
        if heap and now > heap[0]:
            heappush(heap, now)
            continue
        chosen.append((j, i, False))
        spent += cost
        goals = {g: s for g, s in goals.items() if not (s[0] >= j and s[1] < i)}
        covered[j:i] = [True] * (i - j)
    first = None
    for u in range(n + 1):
        if u == n or covered[u]:
            if first is not None:
                chosen.append((first, u, True))
            first = None
        elif first is None:
            first = u
        elif units[u]["end"] - units[first]["start"] > size:
            chosen.append((first, u, True))
            first = u
    return [_chunk(text, units[j]["start"], units[i - 1]["end"], first_unit=j, end_unit=i, gap=g) for j, i, g in sorted(chosen, key=lambda c: c[:2])]


_CODE = r"def |class |function |export |public |private "


def records(text: str, size: int = LAB_SIZE) -> list[dict]:
    """Records of an email thread, a table (its header repeated), code, or blocks that start a question or heading."""
    text = text.replace("\r\n", "\n")
    if re.search(r"(?im)^(?:From|Subject):\s", text):
        blocks = ["\n".join(x for x in b.split("\n") if not x.startswith(">")) for b in re.split(r"(?i)\n(?=From:\s)", text)]
    elif re.search(r"(?m)^\s*\|.*\|\s*$|^[^,\n]+(?:,[^,\n]*){3,}$", text):
        rows = [x for x in text.split("\n") if x.strip()]
        blocks, held, length = [], [], 0
        for row in rows[1:]:
            if held and length + 1 + len(row) > size:
                blocks.append("\n".join([rows[0], *held]))
                held = []
            length = (length if held else len(rows[0])) + 1 + len(row)
            held.append(row)
        if held:
            blocks.append("\n".join([rows[0], *held]))
    elif re.search(rf"(?m)^\s*(?:{_CODE})", text):
        blocks = re.split(rf"\n(?=\s*(?:{_CODE}|async function ))", text)
    else:
        blocks = re.split(r"(?m)\n\s*\n(?=[^\n]*\?\s*$|Q[:.]|\*\*Q|#)", text)
    out, after = [], 0
    for b in blocks:
        if b.strip():
            start = text.find(b[:40], after)
            after = max(after, start + 1)
            out.append(_chunk(text, start, start + len(b), text=b.strip()))
    return out


STRATEGIES: dict[str, Callable[..., list[dict]]] = {"fixed": lab_windows, "sentence": lab_sentences, "struct": lab_structure, "record": records, "qesdp": lab_segments, "qesov": lab_overlapping}
SUPERVISED = ("qesdp", "qesov")


def _placed(text: str, chunks: list[dict]) -> list[dict]:
    """Adds the provision of the first unit that each chunk touches, and the sections that its span mentions."""
    text, units, _ = parse(text)
    ends = [u["end"] for u in units]
    for c in chunks:
        at = bisect_right(ends, c["start"])
        c["home"] = units[at]["prov"] if at < len(units) else None
        c["mentions"] = _REFERENCE.findall(text[c["start"] : c["end"]])
    return chunks


def chunked(text: str | None, strategy: str, size: int = LAB_SIZE, questions=None, **options) -> list[dict]:
    """One document's chunks by a strategy, placed among its provisions."""
    own = ([list(q) for q in (questions if questions is not None else [])],) if strategy in SUPERVISED else ()
    return _placed(text or "", STRATEGIES[strategy](text or "", *own, size, **options))


def lab_chunks(docs: DataFrame, strategy: str | tuple[str, ...], size: int = LAB_SIZE, **options) -> DataFrame:
    """Chunks of documents (doc_id, text; supervised strategies: questions array<array<string>> of evidence texts too).

    doc_id, strategy, chunk_no, start, end, text, words, prov, refs, first_unit, end_unit, gap, home (the provision of the
    first unit touched), mentions (section numbers in its span). Several strategies run in one pass over ``docs``, which parses
    each document once.
    """
    strategies = (strategy,) if isinstance(strategy, str) else strategy
    named = f"array<struct<strategy:string,chunks:{_CHUNK}>>"

    def every(text, questions=None) -> list[dict]:
        return [{"strategy": s, "chunks": chunked(text, s, size, questions, **options)} for s in strategies]

    if any(s in SUPERVISED for s in strategies):

        @F.pandas_udf(named)
        def run(text: pd.Series, questions: pd.Series) -> pd.Series:
            return pd.Series([every(t, own) for t, own in zip(text, questions, strict=True)])

        found = run(F.col("text"), F.col("questions"))
    else:

        @F.pandas_udf(named)
        def run(text: pd.Series) -> pd.Series:
            return pd.Series([every(t) for t in text])

        found = run(F.col("text"))
    each = docs.select("doc_id", F.explode(found).alias("s"))
    return each.select("doc_id", "s.strategy", F.posexplode("s.chunks").alias("chunk_no", "c")).select("doc_id", "strategy", "chunk_no", "c.*")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, i, start, end, type, level, text, prov of each document's headings and sentences."""

    @F.pandas_udf("array<struct<start:int,end:int,type:string,level:int,text:string,prov:int>>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([parse(t or "")[1] for t in text])

    return docs.select("doc_id", F.posexplode(run("text")).alias("i", "u")).select("doc_id", "i", "u.*")


def provisions(docs: DataFrame) -> DataFrame:
    """doc_id, pi, id, title, path, units, start, end of each document's provisions."""

    @F.pandas_udf("array<struct<id:string,title:string,path:array<string>,units:array<int>,start:int,end:int>>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([parse(t or "")[2] for t in text])

    return docs.select("doc_id", F.posexplode(run("text")).alias("pi", "p")).select("doc_id", "pi", "p.*")


def with_heading_path(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunks prefixed with the path of the first provision that they touch and the titles of the others (interval join)."""
    touched = chunks.select("doc_id", "strategy", "chunk_no", "start", "end").alias("c").join(
        parts.alias("p"), F.expr("c.doc_id = p.doc_id and p.start < c.end and p.end > c.start")
    )
    heads = touched.groupBy("c.doc_id", "c.strategy", "c.chunk_no").agg(F.sort_array(F.collect_list(F.struct("p.pi", "p.path", "p.title"))).alias("h"))
    others = F.transform(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), lambda x: x["title"])
    label = F.concat(F.lit("["), F.array_join(F.col("h")[0]["path"], " › "), F.when(F.size("h") > 1, F.concat(F.lit(" | "), F.array_join(others, " | "))).otherwise(F.lit("")), F.lit("]\n"))
    out = chunks.join(heads.select("doc_id", "strategy", "chunk_no", label.alias("label")), ["doc_id", "strategy", "chunk_no"], "left")
    text = F.concat(F.coalesce("label", F.lit("")), "text")
    return out.withColumn("text", text).withColumn("words", word_count(F.col("text"))).drop("label")


def preview(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, mean_chars, most_words, heading_share, references: what a chunking of a document looks like."""
    at_heading = F.col("text").rlike(r"^\s*(?:#{1,6}\s|\[)")
    refs = F.coalesce(F.size("refs"), F.lit(0))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("text"))).cast("long").alias("mean_chars"), F.max("words").alias("most_words"), F.avg(at_heading.cast("int")).alias("heading_share"), F.sum(refs).alias("references"))


def previewed(docs: DataFrame, strategy: str, size: int = LAB_SIZE, overlap: int | None = None, budget_words: int = PREVIEW_BUDGET) -> DataFrame:
    """What documents (doc_id, text) look like once chunked by a recommended strategy.

    doc_id, used, n_chunks, mean_chars, most_words, heading_share, references, too_big. Plain numbered headings count
    as headings. Chunks by structure need two provisions; other documents fall back to sentence windows, as does a supervised
    strategy, which keeps its name in ``used``. heading_share: chunks that start at a heading; null for records and documents
    without headings. ``too_big``: the largest chunk has more than half the budget, so that one at most fits. Null and
    empty texts have no chunks.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = plain.withColumn("text", marked_headings(F.col("text")))
    window = {"overlap": round(size * PREVIEW_OVERLAP) if overlap is None else overlap}
    if strategy == "struct":
        several = provisions(marked).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("doc_id")
        parts = [(marked.join(several, "doc_id", "left_semi"), "struct", "struct", {}), (marked.join(several, "doc_id", "left_anti"), "sentence", "sentence", window)]
    elif strategy in ("record", "fixed"):
        parts = [(plain if strategy == "record" else marked, strategy, strategy, {})]
    else:
        parts = [(marked, "sentence", strategy, window)]
    heads = units(marked).where("type = 'heading'").select("doc_id", "start").distinct()
    headed = heads.select("doc_id").distinct().withColumn("headed", F.lit(True))
    out = []
    for own, work, used, options in parts:
        chunks = lab_chunks(own, work, size, **options).join(heads.withColumn("head", F.lit(1)), ["doc_id", "start"], "left")
        sums = chunks.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("text"))).cast("long").alias("mean_chars"), F.max("words").alias("most_words"),
            F.avg(F.coalesce("head", F.lit(0))).alias("share"), F.sum(F.coalesce(F.greatest(F.size("refs"), F.lit(0)), F.lit(0))).alias("references"),
        )
        rows = own.select("doc_id", F.lit(used).alias("used")).join(sums, "doc_id", "left").join(headed, "doc_id", "left")
        share = F.when(F.col("headed") & F.lit(used != "record"), F.col("share"))
        out.append(rows.fillna(0, ["n_chunks", "mean_chars", "most_words", "references"]).withColumn("heading_share", share).drop("share", "headed"))
    found = reduce(DataFrame.unionByName, out)
    return found.withColumn("too_big", F.col("most_words") * 2 > budget_words)
