"""The queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from fathomry.functions.text import SPACE, STEM_END, STOP_WORDS
from fathomry.operators.advisor import CATALOGUE, PATTERNS, WEIGHTS
from fathomry.operators.chunking import OVERLAP
from fathomry.operators.search import PROMPT
from fathomry.sources.documents import HIDDEN

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _raw(x: str) -> str:
    return f"string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9_\\-{SPACE}]', '', 'g'), '[{SPACE}]+')"


def _tokens(x: str) -> str:
    return f"list_filter({_raw(x)}, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


def _stem(t: str) -> str:
    return f"CASE WHEN length({t}) > 4 THEN regexp_replace({t}, '{STEM_END}', '') ELSE {t} END"


def _stems(x: str) -> str:
    return f"list_transform({_tokens(x)}, lambda w: {_stem('w')})"


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


_WORDS = f"len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))"
_RAW_COUNT = f"len(string_split_regex(coalesce(text, ''), '[{SPACE}]+'))"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_NORMAL = _squash(r"regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\r\n]+', chr(10), 'g'), '[^\x20-\x7E\n]', '', 'g')")


def _bm25(tokens, size: str) -> str:
    """CTEs from ``documents`` and ``benchmark`` to ``keyword`` (query_id, chunk_id, score)."""
    return f"""
chunks AS (SELECT doc_id AS chunk_id, {tokens('text')} AS terms, CAST({size} AS BIGINT) AS n_tokens FROM documents),
sizes AS (SELECT chunk_id, CASE WHEN n_tokens < 0 THEN len(terms) ELSE n_tokens END AS n_tokens FROM chunks),
stats AS (SELECT count(*) AS n_chunks, avg(n_tokens) AS mean_length FROM sizes),
tf AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
keyword AS (
  SELECT query_id, chunk_id, sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(n_tokens, 1) / mean_length))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (chunk_id), stats GROUP BY ALL)"""


def _sparse(name: str, table: str, key: str, out: str, seed: str = "v1|") -> str:
    return f"""
{name}_words AS (SELECT {out}, token, count(*) AS n FROM (SELECT {key} AS {out}, unnest({_raw('text')}) AS token FROM {table}) WHERE token <> '' GROUP BY ALL),
{name}_hash AS (SELECT token, {_FNV.format(f"'{seed}' || token")} AS h FROM (SELECT DISTINCT token FROM {name}_words)),
{name}_sums AS (SELECT {out}, CAST(h % 1024 AS INT) AS bucket, sum(CASE WHEN (h & 65536) <> 0 THEN n ELSE -n END) AS v FROM {name}_words JOIN {name}_hash USING (token) GROUP BY ALL HAVING v <> 0),
{name} AS (SELECT {out}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {out})) AS weight FROM {name}_sums)"""


_HASHED = _sparse("dv", "documents", "doc_id", "chunk_id") + "," + _sparse("qv", "benchmark", "item_id", "query_id") + ",\nvector AS (SELECT query_id, chunk_id, sum(d.weight * q.weight) AS score FROM dv d JOIN qv q USING (bucket) GROUP BY ALL)"


def _top(rows: str, k: int, part: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank FROM {rows}) WHERE rank <= {k}"


_KEYWORD = _bm25(_tokens, _RAW_COUNT)
_CANDIDATES = f"""WITH {_KEYWORD}, {_HASHED},
kt AS ({_top('keyword', 30)}), vt AS ({_top('vector', 30)}),
most AS (SELECT query_id, max(score) AS most FROM kt GROUP BY ALL),
both_ids AS (SELECT query_id, chunk_id FROM kt UNION SELECT query_id, chunk_id FROM vt),
candidates AS (
  SELECT query_id, chunk_id, coalesce(v.score, 0) AS vector_score, coalesce(k.score, 0) AS keyword_score,
         coalesce(k.score, 0) / coalesce(nullif(most, 0), 1) AS keyword_part
  FROM both_ids LEFT JOIN kt k USING (query_id, chunk_id) LEFT JOIN vector v USING (query_id, chunk_id) LEFT JOIN most USING (query_id)),
hybrid AS (SELECT *, 0.5 * vector_score + 0.5 * keyword_part AS score FROM candidates)"""

_JUDGED = f"""WITH {_KEYWORD},
judged AS (
  SELECT query_id, rank, coalesce(quality = 1, FALSE) AS rel, sum(CAST(coalesce(quality = 1, FALSE) AS INT)) OVER (PARTITION BY query_id ORDER BY rank) AS hits,
         sum(CAST(coalesce(quality = 1, FALSE) AS INT)) OVER (PARTITION BY query_id) AS n
  FROM ({_top('keyword', 10)}) r LEFT JOIN labels l ON r.chunk_id = l.doc_id)"""

_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"
_SECTIONS = f"""
lined AS (SELECT doc_id, lines FROM (SELECT doc_id, {_LINES} AS lines FROM {{0}}) WHERE len(lines) > 0),
sections AS (SELECT doc_id, lines, unnest(range(0, (len(lines) - 1) // 4 + 1)) AS k FROM lined)"""


def _stable(name: str, source: str) -> str:
    return _SECTIONS.format(source).replace("lined", f"{name}_lined").replace("sections", f"{name}_sections") + f""",
{name} AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, p) - 1 AS pos, 's' || k AS section,
         'Document ' || doc_id || ' › Part ' || k || chr(10) || para AS text
  FROM (SELECT doc_id, k, unnest(lines[k * 4 + 1:k * 4 + 4]) AS para, unnest(range(1, len(lines[k * 4 + 1:k * 4 + 4]) + 1)) AS p FROM {name}_sections))"""


def _windows(source: str, size: int, step: int) -> str:
    """SELECT of doc_id, chunk_no, start, text."""
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_no, CAST(s AS INT) AS start,
  CAST(least(s + {size}, length(text)) AS INT) AS "end", substr(text, s + 1, {size}) AS text
FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - {size}) / {step}), 0) AS BIGINT) * {step} + 1, {step})) AS s FROM {source} WHERE length(text) > 0)
WHERE regexp_matches(substr(text, s + 1, {size}), '[^ \\t\\n\\x0b\\f\\r]')"""


_MARKDOWN = f"""{_SECTIONS.format('documents')},
markdown AS (
  SELECT doc_id, '# Document ' || doc_id || chr(10) || string_agg('## ' || (k + 1) || ' Part ' || k || chr(10) || '### ' || (k + 1) || '.1 Rule' || chr(10) || array_to_string(lines[k * 4 + 1:k * 4 + 4], chr(10))
         || CASE WHEN k > 0 THEN chr(10) || 'See Section ' || k || '.1.' ELSE '' END, chr(10) ORDER BY k) AS text
  FROM sections GROUP BY doc_id)"""

# White space as Python's strings have it.
_BLANK = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SENTENCES = f"""list_filter(list_transform(CASE WHEN len(f) > 0 THEN f ELSE [text] END, lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+\\z', '', 'g')), lambda x: x <> '')"""
_SENTENCE = f"'([^.!?]+[.!?]+(?:[{SPACE}]|\\z))', 1"
# Headings and sentences of documents: lists of starts (s) and ends (e) in order.
_UNITS = f"""
plain AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents WHERE text <> ''),
textlines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM plain),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, regexp_matches(line, '^#{{1,6}}[{_BLANK}]') AS heading FROM textlines),
pieces AS (SELECT *, unnest(range(1, len(parts) + 1)) AS p FROM (SELECT *, CASE WHEN heading THEN [line] ELSE regexp_extract_all(line, '(?s).*?[.!?](?:[{_BLANK}]|$)|.+') END AS parts FROM placed)),
units AS (SELECT doc_id, k, p, heading, parts[p] AS x, base + coalesce(list_sum(list_transform(parts[:p - 1], lambda y: length(y))), 0) AS start FROM pieces),
spans AS (SELECT doc_id, k, p, CASE WHEN heading THEN start ELSE start + length(x) - length(regexp_replace(x, '^[{_BLANK}]+', '')) END AS start,
  CASE WHEN heading THEN start + length(x) ELSE start + length(regexp_replace(x, '[{_BLANK}]+$', '')) END AS stop FROM units WHERE heading OR regexp_matches(x, '[^{_BLANK}]')),
listed AS (SELECT doc_id, list(start ORDER BY k, p) AS s, list(stop ORDER BY k, p) AS e FROM spans GROUP BY doc_id)"""


def _first(ids: str, condition: str, otherwise: str) -> str:
    return f"coalesce(list_filter({ids}, lambda u: {condition})[1], {otherwise})"


_EDITED = "edited AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A new first sentence. ' || text ELSE text END AS text FROM documents WHERE text IS NOT NULL)"


def _diffed(name: str, old: str, new: str) -> str:
    return f"""{name} AS (
  SELECT n.doc_id, n.pos, n.text, o.text IS NOT NULL AS reused
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS copy FROM {new}) n
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS copy FROM {old}) o ON n.doc_id = o.doc_id AND n.text = o.text AND n.copy = o.copy)"""


def _summary(name: str, label: str) -> str:
    return f"""SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (NOT reused) AS embedded, min(pos) FILTER (NOT reused) AS first_change,
  coalesce(count(*) - min(pos) FILTER (NOT reused), 0) AS cascade, '{label}' AS chunker FROM {name} GROUP BY doc_id"""


_VERSIONS = f"""WITH {_stable('stable', 'documents')},
sized AS (SELECT doc_id, count(*) AS n_rows FROM stable GROUP BY ALL),
landed AS (SELECT doc_id, n_rows, count(*) FILTER (doc_id % 3 <> 0 OR pos * 2 < n_rows) AS landed FROM stable JOIN sized USING (doc_id) GROUP BY ALL)"""
_UPDATES = """WITH updates AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
         md5(concat_ws('|', CAST(event_id AS VARCHAR), props)) AS hash, ts, event_type = 'error' AS lost FROM events),
newest AS (SELECT doc_id, max(version) AS version, arg_max(hash, version) AS hash FROM updates GROUP BY doc_id),
known AS (SELECT doc_id, max(version) AS version, arg_max(hash, version) AS hash FROM updates WHERE NOT lost GROUP BY doc_id)"""


def _numbers(x: str) -> str:
    return f"regexp_extract_all({x}, '\\b\\d+(?:\\.\\d+)?\\b')"


def _count(*names: str) -> str:
    return " + ".join(f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}'))" for n in names for p in PATTERNS[n])


_COUNTED = [n for n in PATTERNS if n not in ("speaker_turns", "code_fences", "ocr_breaks", "exotic_chars")]
_SPACED = '[^ \\t\\n\\x0b\\f\\r]'
# No look-ahead and no look-behind here: turns are all marked lines less those marked by a header, sentences end at a mark put there.
_CLOCK = r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?"
_TURNS = f"""len(list_filter(regexp_extract_all(t, '(?m){_CLOCK}[A-Z][\\w .''-]{{1,30}}:\\s+\\S'),
    lambda x: NOT regexp_matches(x, '{_CLOCK}(?:From|To|Cc|Bcc|Subject|Sent|Date|Re|Q|A|Question|Answer)\\s*:')))"""
_PROFILE = f"""d AS (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents),
sized AS (SELECT doc_id, t, len(regexp_extract_all(t, '{_SPACED}+')) AS words, len(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 2)) AS sentences,
  len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: regexp_matches(x, '{_SPACED}'))) AS paragraphs FROM d),
profile AS (SELECT doc_id, length(t) AS chars, CAST(words AS BIGINT) AS words, CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}'))) AS BIGINT) AS lines,
  {', '.join(f'CAST({_count(n)} AS BIGINT) AS {n}' for n in _COUNTED)}, CAST({_TURNS} AS BIGINT) AS speaker_turns, ({_count('code_fences')}) / 2 AS code_fences, {_count('ocr_breaks')} + ({_count('exotic_chars')}) / 5 AS ocr_noise,
  CASE WHEN sentences > 0 THEN words / sentences ELSE 0.0 END AS mean_sentence_words, words / greatest(paragraphs, 1) AS mean_paragraph_words FROM sized)"""
_VALUES = lambda rows: "(VALUES " + ", ".join(f"({', '.join(map(repr, row))})" for row in rows) + ")"
# Every signal of a document as a row, met with the rows of weights.
_CATEGORIES = f"""{_PROFILE}, wide AS (SELECT *, md_headings + numbered_headings AS headings, CASE WHEN section_words > 0 THEN section_lines ELSE 0 END AS named_sections,
  CAST(md_headings + numbered_headings = 0 AND mean_sentence_words > 35 AS INT) AS unbroken FROM profile),
signals AS (UNPIVOT (SELECT doc_id, greatest(lines, 1) AS n, CAST(COLUMNS(* EXCLUDE (doc_id)) AS DOUBLE) FROM wide) ON COLUMNS(* EXCLUDE (doc_id, n)) INTO NAME signal VALUE x),
summed AS (SELECT doc_id, category, min(place) AS place, greatest(sum(weight * least(1.0, CASE WHEN by_line THEN x / n * scale ELSE x / scale END) ORDER BY place), 0) AS score
  FROM signals JOIN (SELECT CAST(place AS INT) AS place, category, CAST(weight AS DOUBLE) AS weight, signal, by_line, CAST(scale AS DOUBLE) AS scale FROM {_VALUES([(k, *row) for k, row in enumerate(WEIGHTS)])} v(place, category, weight, signal, by_line, scale)) USING (signal) GROUP BY doc_id, category),
shared AS (SELECT *, score / coalesce(nullif(sum(score ORDER BY score DESC, place) OVER (PARTITION BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 1) AS share FROM summed),
classified AS (SELECT doc_id, CASE WHEN score > 0.4 THEN category ELSE 'narrative' END AS category, score, share FROM shared QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1)"""

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _grounded(rows: str, keys: str) -> str:
    """CTEs a to e: of ``rows`` (keys, query, answer, context) both relevances, what is missing and the faithfulness."""
    return f"""a AS (SELECT *, {_tokens('query')} AS q, list_distinct({_tokens('answer')}) AS terms, list_distinct({_numbers('answer')}) AS nums, {_numbers('context')} AS held,
  list_transform(string_split_regex(answer, '[.!?]+'), lambda s: string_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ')) AS parts FROM {rows}),
b AS (SELECT *, list_distinct(list_transform(list_filter(list_transform(flatten(list_transform(parts, lambda p: p[2:])), lambda x: regexp_replace(x, '[^a-zA-Z0-9_]', '', 'g')), lambda x: regexp_matches(x, '^[A-Z]')), lambda x: lower(x))) AS named FROM a),
c AS (SELECT *, list_filter((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i) GROUP BY x ORDER BY i LIMIT 15)), lambda x: NOT list_contains(named, x)) AS keys
  FROM (SELECT *, list_filter({_tokens('answer')}, lambda t: length(t) > 4) AS l FROM b)),
d AS (SELECT *, list_transform(list_filter(nums, lambda n: len(list_filter(held, lambda h: contains('.' || h || '.', '.' || n || '.'))) = 0), lambda n: 'Number "' || n || '" not found in sources')
    || list_transform(list_filter(named, lambda x: NOT contains(lower(context), x)), lambda x: 'Entity "' || x || '" not found in sources')
    || list_transform(list_filter(coalesce(keys, []), lambda x: NOT contains(lower(context), x)), lambda x: 'Key term "' || x || '" not found in sources') AS missing, len(nums) + len(named) + len(coalesce(keys, [])) AS checks FROM c),
e AS (SELECT {keys}, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda t: contains(lower(context), t))) / len(q) END AS context_relevance,
  CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda t: contains(lower(answer), t))) / len(q) END AS answer_relevance, missing,
  CASE WHEN answer = '' OR checks = 0 THEN 1.0 ELSE 1 - len(missing) / checks END AS faithfulness FROM d)"""


_TURN_PAIRS = "w WHERE role = 'assistant' AND asker = 'user'"
_CONTEXTS = f"""few AS ({_top('hybrid', 5)}), texts AS (
  SELECT query_id, string_agg('[Source ' || rank || ': ' || coalesce(source, 'Document') || ' (Page 1)]' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS c FROM few JOIN documents ON chunk_id = doc_id GROUP BY query_id)"""
# Provisions of markdown documents: an ancestor stands until a heading of its level or a higher one.
_PROVISIONS = _UNITS.replace("FROM documents WHERE", "FROM markdown WHERE") + f""",
named AS (SELECT doc_id, k, base, length(line) AS n, length(regexp_extract(line, '^#+')) AS level, regexp_replace(regexp_replace(line, '^#+[{_BLANK}]+', ''), '[{_BLANK}]+$', '') AS title FROM placed WHERE heading),
heads AS (SELECT *, regexp_extract(title, '^\\d+(?:\\.\\d+)*') AS name, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM named),
standing AS (SELECT a.doc_id, a.k, a.level, a.title, min(b.k) AS until FROM heads a LEFT JOIN heads b ON a.doc_id = b.doc_id AND b.k > a.k AND b.level <= a.level GROUP BY ALL),
ancestors AS (SELECT h.doc_id, h.k, list(a.title ORDER BY a.k) AS path FROM heads h JOIN standing a ON a.doc_id = h.doc_id AND a.k < h.k AND a.level < h.level AND coalesce(a.until, h.k) >= h.k WHERE a.level > 1 GROUP BY ALL),
provisions AS (SELECT doc_id, h.k, any_value(name) AS name, any_value(next) AS next, list_append(coalesce(any_value(path), []), any_value(title)) AS path, any_value(CASE WHEN name = '' THEN title ELSE trim(ltrim(substr(title, length(name) + 1), '. ')) END) AS title, any_value(base) AS start, greatest(any_value(base + n), coalesce(max(stop), 0)) AS stop
  FROM heads h LEFT JOIN ancestors USING (doc_id, k) LEFT JOIN (SELECT doc_id, k AS line, stop FROM spans) s USING (doc_id) WHERE (level >= 3 OR contains(name, '.')) AND (line IS NULL OR line >= h.k AND line < coalesce(next, line + 1)) GROUP BY doc_id, h.k)"""
# Chunks of one provision each, their sentences packed by span, followed by the provisions that they name.
_STRUCTURE = f"""sentences AS (SELECT p.doc_id, p.k, row_number() OVER (PARTITION BY p.doc_id, p.k ORDER BY s.k, s.p) AS i, s.start, s.stop, substr(text, CAST(s.start AS BIGINT) + 1, CAST(s.stop - s.start AS BIGINT)) AS x
  FROM provisions p JOIN spans s ON s.doc_id = p.doc_id AND s.k > p.k AND s.k < coalesce(p.next, s.k + 1) JOIN plain d ON d.doc_id = p.doc_id),
beyond AS (SELECT a.doc_id, a.k, a.i, min(b.i) AS next FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i > a.i AND b.stop - a.start > 450 GROUP BY ALL),
firsts AS (SELECT doc_id, k, CAST(1 AS BIGINT) AS i FROM provisions UNION ALL SELECT doc_id, k, b.next FROM firsts JOIN beyond b USING (doc_id, k, i)),
parts AS (SELECT f.doc_id, f.k, f.i, string_agg(x, ' ' ORDER BY s.i) AS own, min(s.start) AS start, max(s.stop) AS stop FROM firsts f LEFT JOIN beyond b USING (doc_id, k, i)
  LEFT JOIN sentences s ON s.doc_id = f.doc_id AND s.k = f.k AND s.i >= f.i AND s.i < coalesce(b.next, s.i + 1) GROUP BY ALL),
bodies AS (SELECT doc_id, k, string_agg(x, ' ' ORDER BY i) AS body FROM (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id, k ORDER BY i) - 1 AS upto FROM sentences) WHERE i = 1 OR upto <= 320 GROUP BY ALL),
cites AS (SELECT doc_id, k, i, unnest(found) AS name, generate_subscripts(found, 1) AS n FROM (SELECT p.doc_id, p.k, p.i,
  regexp_extract_all(substr(text, CAST(CASE WHEN i = 1 THEN v.start ELSE p.start END AS BIGINT) + 1, CAST(coalesce(p.stop, v.stop) - CASE WHEN i = 1 THEN v.start ELSE p.start END AS BIGINT)), 'Section (\\d+(?:\\.\\d+)+)', 1) AS found FROM parts p JOIN provisions v USING (doc_id, k) JOIN plain USING (doc_id))),
cited AS (SELECT c.doc_id, c.k, c.i, t.k AS target, min(n) AS n FROM cites c JOIN (SELECT doc_id, name, max(k) AS k FROM provisions GROUP BY ALL) t USING (doc_id, name) WHERE t.k <> c.k GROUP BY ALL),
shown AS (SELECT c.doc_id, c.k, c.i, count(*) AS n_refs, string_agg(chr(10) || '↳ Section ' || name || ' ' || title || ': ' || coalesce(body, ''), '' ORDER BY n) AS shown
  FROM cited c JOIN provisions v ON v.doc_id = c.doc_id AND v.k = target LEFT JOIN bodies b ON b.doc_id = c.doc_id AND b.k = target GROUP BY ALL),
structure AS (SELECT doc_id, k, i, CASE WHEN i = 1 THEN v.start ELSE p.start END AS start, coalesce(p.stop, v.stop) AS stop, coalesce(n_refs, 0) AS n_refs, '[' || array_to_string(path, ' › ') || ']' || chr(10) || coalesce(own, '') || coalesce(shown, '') AS text FROM parts p JOIN provisions v USING (doc_id, k) LEFT JOIN shown USING (doc_id, k, i))"""
# The window from each hit on that holds every token of the query that the text has.
_RERANKED = f"""pool AS (SELECT query_id, chunk_id, score, {_tokens('b.text')} AS tokens, regexp_split_to_array(regexp_replace(lower(coalesce(d.text, '')), '[^a-z0-9_{SPACE}]', '', 'g'), '[{SPACE}]+') AS words
  FROM ({_top('hybrid', 15)}) JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id),
wanted AS (SELECT query_id, chunk_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM pool), placed AS (SELECT query_id, chunk_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM pool),
hits AS (SELECT query_id, chunk_id, i, pos FROM wanted JOIN placed USING (query_id, chunk_id, token)),
counted AS (SELECT query_id, chunk_id, i, pos, n_present FROM hits JOIN (SELECT query_id, chunk_id, count(DISTINCT i) AS n_present FROM hits GROUP BY ALL) USING (query_id, chunk_id)),
reach AS (SELECT a.query_id, a.chunk_id, a.pos, b.i, min(b.pos) AS next, any_value(b.n_present) AS n_present FROM (SELECT DISTINCT query_id, chunk_id, pos FROM counted) a JOIN counted b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos >= a.pos GROUP BY ALL),
windows AS (SELECT query_id, chunk_id, count(*) AS size, max(next) - pos AS span, any_value(n_present) AS n_present FROM reach GROUP BY query_id, chunk_id, pos),
nearest AS (SELECT query_id, chunk_id, any_value(n_present) AS n_present, min(span) AS span FROM (SELECT *, max(size) OVER (PARTITION BY query_id, chunk_id) AS most FROM windows) WHERE size = most AND most >= 2 GROUP BY ALL),
closeness AS (SELECT query_id, chunk_id, 0.4 * score + 0.6 * CASE WHEN span IS NULL THEN 0 ELSE 0.6 * n_present / len(tokens) + 0.4 / (1 + span / 5) END AS score FROM pool LEFT JOIN nearest USING (query_id, chunk_id))"""

ORACLE_SQL = {
    "tokenize_stats": f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_words, CAST({_RAW_COUNT} AS BIGINT) AS n_raw, CAST(len({_tokens('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_stems('text')})) AS BIGINT) AS n_stems FROM documents",
    "normalize_text": f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_NORMAL} AS t FROM documents)",
    "sentence_split": f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(CASE WHEN len(f) > 0 THEN f ELSE [text] END, lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+\\z', '', 'g')), lambda x: x <> '') AS s
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '([^.!?]+[.!?]+(?:[{SPACE}]|\\z))', 1) AS f FROM documents))""",
    "fnv_hash": f"SELECT item_id AS query_id, lpad(lower(to_hex({_FNV.format('text')})), 8, '0') AS hash FROM benchmark",
    "page_text": f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '(?i)<h([1-6])[^>]*>', chr(10) || chr(10) || '### ', 'g'), '(?i)<(?:p|div|li|br|tr|/h[1-6])\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')) AS t FROM a)
SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM b""",
    "postings": f"SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL",
    "corpus_stats": f"SELECT count(*) AS n_chunks, round(avg({_RAW_COUNT}), 6) AS mean_length FROM documents",
    "bm25_topk": f"WITH {_KEYWORD} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('keyword', 20)})",
    "mini_bm25_topk": f"WITH {_bm25(_stems, '-1')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('keyword', 20)})",
    "vector_topk": f"""WITH v AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.chunk_id AS query_id, v.chunk_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS score FROM v q, v WHERE q.chunk_id % 20 = 0)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('s', 30)})""",
    "hashed_embedding_sparse": f"WITH {_sparse('dv', 'documents', 'doc_id', 'doc_id')} SELECT doc_id, bucket, round(weight, 6) AS weight FROM dv",
    "hashed_search": f"WITH {_HASHED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('vector', 5)})",
    "hybrid_fusion": f"{_CANDIDATES} SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score, round(keyword_part, 6) AS keyword_part, round(score, 6) AS score, rank FROM ({_top('hybrid', 15)})",
    "retrieval_modes": f"""{_CANDIDATES}, each AS (SELECT query_id, mode, chunk_id, w * vector_score + (1 - w) * keyword_part AS score FROM candidates, (VALUES ('hybrid', 0.5), ('keyword', 0.0), ('vector', 1.0)) m(mode, w))
SELECT query_id, mode, rank, chunk_id, round(score, 6) AS score FROM ({_top('each', 15, 'query_id, mode')})""",
    "rerank_proximity": f"{_CANDIDATES}, {_RERANKED} SELECT query_id, rank, chunk_id, round(score, 6) AS confidence FROM ({_top('closeness', 5)})",
    "context_assembly": f"{_CANDIDATES}, {_CONTEXTS} SELECT query_id, length(c) AS n_chars, md5(c) AS digest FROM texts",
    "answers": f"""{_CANDIDATES}, {_CONTEXTS}, pieces AS (SELECT query_id, b.text AS query, c AS context, {_tokens('b.text')} AS tokens, string_split(regexp_replace(c, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM texts JOIN benchmark b ON item_id = query_id),
replies AS (SELECT query_id, query, context, coalesce(list_filter(pieces, lambda s: len(list_filter(tokens, lambda t: contains(lower(s), t))) > 0)[1], pieces[1]) AS answer FROM pieces),
{_grounded('replies', 'query_id, query, context, answer')}
SELECT query_id, length({_quoted(PROMPT)} || 'Sources:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query) AS prompt_chars, answer, array_to_string(regexp_extract_all(context, '\\[(?:Source\\s*)?(\\d{{1,9}})\\]', 1), ',') AS cited,
  round(faithfulness, 6) AS faithfulness, CAST(len(missing) > 0 AND faithfulness < 0.8 AS BOOLEAN) AS flagged FROM e""",
    "doc_delete_cascade": f"""WITH p AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents WHERE source IS DISTINCT FROM 'src0') GROUP BY ALL)
SELECT count(*) AS n_postings, count(DISTINCT term) AS n_terms, (SELECT count(*) FROM documents WHERE source IS DISTINCT FROM 'src0') AS n_chunks FROM p""",
    "store_stats": f"SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) AS n_chunks, CAST(sum({_WORDS}) AS BIGINT) AS n_words FROM ({_windows('documents', 500, 450)})",
    "chunk_preview": f"""WITH RECURSIVE {_MARKDOWN}, {_PROVISIONS}, {_STRUCTURE} SELECT doc_id, count(*) AS n_chunks, CAST(round(avg(length(text))) AS BIGINT) AS mean_chars, CAST(max({_WORDS}) AS INT) AS most_words,
  round(avg(CAST(regexp_matches(text, '^\\s*(?:#{{1,6}}\\s|\\[)') AS INT)), 6) AS heading_share, CAST(sum(n_refs) AS BIGINT) AS "references" FROM structure GROUP BY doc_id""",
    "chunk_graph_edges": f"""WITH RECURSIVE {_MARKDOWN}, {_PROVISIONS}, {_STRUCTURE}, chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS c FROM structure),
targets AS (SELECT doc_id, name, arg_min(start, k) AS start, arg_min(stop, k) AS stop FROM provisions GROUP BY ALL),
terms AS (SELECT doc_id, c, len(terms) AS n, unnest(terms) AS term FROM (SELECT doc_id, c, list_distinct({_stems('text')}) AS terms FROM chunks)),
alike AS (SELECT x.doc_id, count(*) / (x.n + y.n - count(*)) AS j FROM terms x JOIN terms y ON x.doc_id = y.doc_id AND x.term = y.term AND x.c < y.c GROUP BY x.doc_id, x.c, y.c, x.n, y.n),
edges AS (SELECT doc_id, 'adjacent' AS kind, 1.0::DOUBLE AS weight FROM chunks WHERE c > 1
  UNION ALL SELECT a.doc_id, 'xref', 1.0 FROM cites JOIN chunks a USING (doc_id, k, i) JOIN targets t ON t.doc_id = a.doc_id AND t.name = cites.name JOIN chunks b ON b.doc_id = a.doc_id AND b.start < t.stop AND b.stop > t.start AND b.c <> a.c WHERE a.start >= t.stop OR a.stop <= t.start
  UNION ALL SELECT x.doc_id, 'section', 0.5 FROM chunks x JOIN chunks y ON x.doc_id = y.doc_id AND x.k = y.k AND y.c > x.c + 1
  UNION ALL SELECT doc_id, 'lexical', 2 * j FROM alike WHERE j >= 0.18)
SELECT doc_id, kind, count(*) AS n_edges, round(sum(weight), 6) AS weight FROM edges GROUP BY ALL""",
    "headed_chunks": f"""WITH {_MARKDOWN}, {_PROVISIONS}, windows AS ({_windows('markdown', 450, 450 - OVERLAP)}),
labels AS (SELECT w.doc_id, chunk_no, '[' || array_to_string(first(path ORDER BY k), ' › ') || CASE WHEN count(*) > 1 THEN ' | ' || array_to_string(list(title ORDER BY k)[2:], ' | ') ELSE '' END || ']' || chr(10) AS label
  FROM windows w JOIN provisions p ON p.doc_id = w.doc_id AND p.start < w."end" AND p.stop > w.start GROUP BY w.doc_id, chunk_no)
SELECT doc_id, chunk_no, CAST({_WORDS} AS INT) AS words, md5(text) AS digest FROM (SELECT doc_id, chunk_no, coalesce(label, '') || text AS text FROM windows LEFT JOIN labels USING (doc_id, chunk_no))""",
    "evidence_location": f"""WITH {_MARKDOWN}
SELECT doc_id, item_id AS query_id, CAST(instr(m.text, b.text) - 1 AS BIGINT) AS start, CAST(instr(m.text, b.text) - 1 + length(b.text) AS BIGINT) AS "end"
FROM markdown m JOIN benchmark b ON b.text <> '' AND contains(m.text, b.text)""",
    "retrieval_stages": f"""{_CANDIDATES}, fused AS ({_top('hybrid', 15)}), best AS (SELECT * FROM fused WHERE rank <= 5),
stages AS (
  SELECT 'vectors' AS stage, count(*) AS n_rows FROM documents UNION ALL SELECT 'vector', count(*) FROM vt UNION ALL SELECT 'keyword', count(*) FROM kt
  UNION ALL SELECT 'fused', count(*) FROM fused UNION ALL SELECT 'best', count(*) FROM best)
SELECT stage, n_rows, TRUE AS timed, (SELECT round(avg(c), 6) FROM (SELECT avg(score) AS c FROM best GROUP BY query_id)) AS confidence FROM stages""",
    "link_rank": f"""WITH RECURSIVE {_KEYWORD},
held AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)),
links AS (
  SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b, 1.0::DOUBLE AS weight FROM documents
  UNION ALL SELECT a, doc_id, 2.0 FROM (SELECT *, min(doc_id) OVER (PARTITION BY query_id) AS a FROM held) WHERE doc_id <> a),
both_ways AS (SELECT source, target, sum(weight) AS weight FROM (SELECT a AS source, b AS target, weight FROM links UNION ALL SELECT b, a, weight FROM links) WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL),
shares AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM both_ways),
best AS ({_top('keyword', 3)}),
seeds AS (SELECT query_id, chunk_id AS node, score / sum(score) OVER (PARTITION BY query_id) AS mass FROM best),
p AS (
  SELECT 0 AS step, query_id, node, mass FROM seeds
  UNION ALL
  SELECT step, query_id, node, sum(mass) FROM (
    SELECT step + 1 AS step, query_id, target AS node, 0.5 * mass * share AS mass FROM p JOIN shares ON node = source WHERE step < 25
    UNION ALL SELECT step + 1, s.query_id, s.node, 0.5 * s.mass FROM (SELECT DISTINCT step FROM p WHERE step < 25), seeds s)
  GROUP BY ALL),
reached AS (SELECT query_id, node AS chunk_id, mass AS score FROM p WHERE step = 25)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('reached', 10)})""",
    "model_mix": f"""WITH {_MARKDOWN}, {_sparse('d1', 'documents', 'doc_id', 'chunk_id', 'v1|')}, {_sparse('d2', 'documents', 'doc_id', 'chunk_id', 'v2|')},
{_sparse('q1', 'benchmark', 'item_id', 'query_id', 'v1|')}, {_sparse('q2', 'benchmark', 'item_id', 'query_id', 'v2|')},
mixed AS (SELECT * FROM d1 WHERE chunk_id % 4 <> 0 UNION ALL SELECT * FROM d2 WHERE chunk_id % 4 = 0),
expected AS (SELECT item_id AS query_id, min(doc_id) AS expected FROM markdown m JOIN benchmark b ON b.text <> '' AND contains(m.text, b.text) GROUP BY ALL),
runs AS (
  SELECT 'before' AS "index", query_id, chunk_id, sum(d.weight * q.weight) AS score FROM d1 d JOIN q1 q USING (bucket) GROUP BY ALL
  UNION ALL SELECT 'mixed, new queries', query_id, chunk_id, sum(d.weight * q.weight) FROM mixed d JOIN q2 q USING (bucket) GROUP BY ALL
  UNION ALL SELECT 'mixed, old queries', query_id, chunk_id, sum(d.weight * q.weight) FROM mixed d JOIN q1 q USING (bucket) GROUP BY ALL
  UNION ALL SELECT 'after', query_id, chunk_id, sum(d.weight * q.weight) FROM d2 d JOIN q2 q USING (bucket) GROUP BY ALL),
best AS ({_top('runs', 5, '"index", query_id')})
SELECT "index", round(avg(CAST(hit AS INT)), 6) AS recall FROM (
  SELECT n."index", query_id, coalesce(bool_or(chunk_id = expected), FALSE) AS hit
  FROM (SELECT DISTINCT "index" FROM runs) n CROSS JOIN expected LEFT JOIN best USING ("index", query_id) GROUP BY ALL) GROUP BY "index" """,
    "store_upsert": f"""WITH held AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'revised' ELSE source END AS name, CASE WHEN doc_id % 10 = 0 THEN 'A revised edition. ' || text ELSE text END AS text FROM documents WHERE text IS NOT NULL),
chunks AS ({_windows('held', 500, 450)}),
counts AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id),
terms AS (SELECT doc_id, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_terms FROM (
  SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest({_tokens('text')}) AS term FROM chunks) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, name, md5(text) AS digest, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_postings, 0) AS n_postings, coalesce(n_terms, 0) AS n_terms
FROM held LEFT JOIN counts USING (doc_id) LEFT JOIN terms USING (doc_id)""",
    "ir_metrics": f"""{_JUDGED} SELECT query_id, round(count(*) FILTER (rel AND rank <= 5) / 5, 6) AS precision,
  round(CASE WHEN max(n) > 0 THEN count(*) FILTER (rel AND rank <= 5) / max(n) ELSE 0 END, 6) AS recall, round(coalesce(1 / min(rank) FILTER (rel), 0), 6) AS mrr,
  round(CASE WHEN max(n) > 0 THEN coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 5), 0) / list_sum(list_transform(range(1, CAST(least(max(n), 5) AS BIGINT) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END, 6) AS ndcg,
  round(coalesce(avg(hits / rank) FILTER (rel), 0), 6) AS average_precision FROM judged GROUP BY query_id""",
    "pr_curve": f"""{_JUDGED} SELECT query_id, CAST(hits AS BIGINT) AS point, round(hits / rank, 6) AS precision, round(hits / n, 6) AS recall FROM judged WHERE rel
UNION ALL SELECT DISTINCT query_id, 0, 1.0, 0.0 FROM judged""",
    "groundedness": f"""WITH w AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS answer, lag(role) OVER o AS asker, lag(text) OVER o AS query, concat_ws(chr(10), lag(text, 2) OVER o, lag(text) OVER o) AS context
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
{_grounded(_TURN_PAIRS, 'conv_id, turn')}
SELECT conv_id, turn, round(context_relevance, 6) AS context_relevance, round(answer_relevance, 6) AS answer_relevance, round(faithfulness, 6) AS faithfulness, CAST(len(missing) AS BIGINT) AS n_mismatches, CAST(len(missing) > 0 AND faithfulness < 0.8 AS BOOLEAN) AS flagged FROM e""",
    "fixed_chunks": f"SELECT doc_id, chunk_no, start, \"end\", CAST({_WORDS} AS BIGINT) AS words, md5(text) AS digest FROM ({_windows('documents', 500, 450)})",
    "sentence_chunks": f"""WITH RECURSIVE
split AS (SELECT doc_id, {_SENTENCES} AS x FROM (SELECT doc_id, text, regexp_extract_all(text, {_SENTENCE}) AS f FROM (SELECT doc_id, {_NORMAL} AS text FROM documents))),
summed AS (SELECT doc_id, x, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[:i], lambda y: length(y) + 1)), 0)) AS p FROM split WHERE len(x) > 0),
cut AS (
  SELECT doc_id, x, p, 0 AS no, 1 AS first, 1 AS fresh, {_first("range(2, len(x) + 1)", "p[u + 1] - 1 > 500", "len(x) + 1")} AS stop FROM summed
  UNION ALL
  SELECT doc_id, x, p, no, first, fresh, {_first("range(fresh + 1, len(x) + 1)", "p[u + 1] - p[first] - 1 + CAST(first < fresh AS INT) > 500", "len(x) + 1")}
  FROM (SELECT doc_id, x, p, no + 1 AS no, {_first("range(first, stop)", "p[stop] - p[u] <= 50", "stop")} AS first, stop AS fresh FROM cut WHERE stop <= len(x)))
SELECT doc_id, CAST(no AS INT) AS chunk_no, CAST({_RAW_COUNT} AS INT) AS n_tokens, md5(text) AS digest
FROM (SELECT doc_id, no, trim(array_to_string(x[first:fresh - 1], ' ') || CASE WHEN first < fresh THEN '  ' ELSE '' END || array_to_string(x[fresh:stop - 1], ' ')) AS text FROM cut)""",
    "record_chunks": f"""WITH RECURSIVE
listed AS (SELECT o_custkey AS doc_id, list(concat_ws(',', o_orderkey, o_orderstatus, o_totalprice, o_orderpriority) ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey),
summed AS (SELECT doc_id, x, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[:i], lambda y: length(y) + 1)), 0)) AS p FROM listed),
cut AS (
  SELECT doc_id, x, p, 0 AS no, 1 AS first, {_first("range(2, len(x) + 1)", "27 + p[u + 1] > 450", "len(x) + 1")} AS stop FROM summed
  UNION ALL
  SELECT doc_id, x, p, no + 1, stop, {_first("range(stop + 1, len(x) + 1)", "27 + p[u + 1] - p[stop] > 450", "len(x) + 1")} FROM cut WHERE stop <= len(x))
SELECT doc_id, CAST(no AS INT) AS chunk_no, CAST({_WORDS} AS INT) AS words, md5(text) AS digest
FROM (SELECT doc_id, no, 'order,status,price,priority' || chr(10) || array_to_string(x[first:stop - 1], chr(10)) AS text FROM cut)""",
    "sql_chunks": f"""WITH RECURSIVE {_UNITS},
cut AS (
  SELECT doc_id, s, e, 0 AS no, 1 AS first, {_first("range(2, len(s) + 1)", "e[u] - s[1] > 450", "len(s) + 1")} AS stop FROM listed
  UNION ALL
  SELECT doc_id, s, e, no, first, {_first("range(fresh + 1, len(s) + 1)", "e[u] - s[first] > 450", "len(s) + 1")}
  FROM (SELECT doc_id, s, e, no + 1 AS no, {_first("range(first, stop)", "e[stop - 1] - s[u] <= 50", "stop")} AS first, stop AS fresh FROM cut WHERE stop <= len(s)))
SELECT doc_id, CAST(no AS INT) AS chunk_no, CAST(since AS INT) AS start, CAST(upto AS INT) AS "end", CAST(len(regexp_extract_all(text, '[^{_BLANK}]+')) AS INT) AS words, md5(text) AS digest
FROM (SELECT doc_id, no, s[first] AS since, e[stop - 1] AS upto, substr(plain.text, CAST(s[first] + 1 AS BIGINT), CAST(e[stop - 1] - s[first] AS BIGINT)) AS text FROM cut JOIN plain USING (doc_id))""",
    "section_windows": f"""WITH {_SECTIONS.format('documents')},
parts AS (SELECT doc_id, k, '## Part ' || k || chr(10) || chr(10) || array_to_string(lines[k * 4 + 1:k * 4 + 4], chr(10) || chr(10)) AS part FROM sections),
heads AS (SELECT doc_id, k, part, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM parts),
whole AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY k) AS text FROM parts GROUP BY doc_id),
cut AS ({_windows('whole', 400, 400)})
SELECT c.doc_id, c.chunk_no AS pos, arg_max('s' || h.k, h.at) AS section, md5(any_value(c.text)) AS digest FROM cut c JOIN heads h ON c.doc_id = h.doc_id AND h.at <= c.start GROUP BY c.doc_id, c.chunk_no""",
    "stable_chunks": f"WITH {_stable('stable', 'documents')} SELECT doc_id, CAST(pos AS INT) AS pos, section, md5(text) AS digest FROM stable",
    "doc_signals": f"WITH {_PROFILE} SELECT * REPLACE (round(code_fences, 6) AS code_fences, round(ocr_noise, 6) AS ocr_noise, round(mean_sentence_words, 6) AS mean_sentence_words, round(mean_paragraph_words, 6) AS mean_paragraph_words) FROM profile",
    "doc_category": f"WITH {_CATEGORIES} SELECT doc_id, category, round(score, 6) AS score, round(share, 6) AS share FROM classified JOIN profile USING (doc_id) WHERE chars >= 80",
    "recommend": f"""WITH {_CATEGORIES}, recipes AS (SELECT category, strategy = 'qesov' AS unsupervised, CASE WHEN strategy = 'qesov' THEN 'sentence' ELSE strategy END AS strategy, CASE WHEN high > 360 THEN least(low, 216) ELSE low END AS low, least(high, 360) AS high,
  high > 360 AS capped, overlap, resolve_refs, retrieval FROM {_VALUES(CATALOGUE)} v(category, strategy, low, high, overlap, heading_path, resolve_refs, retrieval))
SELECT doc_id, category, strategy, CAST(low AS INT) AS low, CAST(high AS INT) AS high, CAST(least(overlap, round(high * 0.25)) AS INT) AS overlap, CAST(round((low + high) / 2) AS INT) AS lab_size, CAST(150 AS INT) AS budget_words, retrieval,
  CAST(1 + CAST(capped AS INT) + CAST(unsupervised AS INT) + CAST(cross_refs >= 2 AND NOT resolve_refs AS INT) + CAST(md_headings + numbered_headings >= 3 AND strategy = 'sentence' AS INT) + CAST(quoted >= 3 AS INT) AS INT) AS n_notes
FROM classified JOIN profile USING (doc_id) JOIN recipes USING (category)""",
    "hash_diff": f"""WITH base AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_EDITED}, {_stable('sa', 'base')}, {_stable('sb', 'edited')},
wa AS (SELECT doc_id, chunk_no AS pos, text FROM ({_windows('base', 400, 400)})), wb AS (SELECT doc_id, chunk_no AS pos, text FROM ({_windows('edited', 400, 400)})),
{_diffed('ds', 'sa', 'sb')}, {_diffed('dw', 'wa', 'wb')} {_summary('dw', 'windows')} UNION ALL {_summary('ds', 'stable')}""",
    "replaced_chunks": f"""WITH base AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_EDITED}, {_stable('sa', 'base')}, {_stable('sb', 'edited')}, {_diffed('came', 'sa', 'sb')}, {_diffed('went', 'sb', 'sa')},
i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, text FROM came WHERE NOT reused), d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, text FROM went WHERE NOT reused)
SELECT doc_id, n, md5(d.text) AS deleted, md5(i.text) AS inserted FROM d FULL JOIN i USING (doc_id, n)""",
    "version_active": f"{_VERSIONS} SELECT doc_id, CASE WHEN landed >= n_rows THEN 13 ELSE 12 END AS active, round(CAST(CASE WHEN landed >= n_rows THEN landed ELSE (SELECT count(*) FROM stable s WHERE s.doc_id = landed.doc_id) END AS DOUBLE) / n_rows, 6) AS coverage, round(landed / n_rows, 6) AS early_coverage FROM landed",
    "collected_rows": f"{_VERSIONS} SELECT doc_id, CASE WHEN landed >= n_rows THEN 13 ELSE 12 END AS oldest, CASE WHEN landed >= n_rows THEN n_rows ELSE 2 * n_rows END AS n_rows FROM landed",
    "gc_series": f"{_UPDATES} SELECT doc_id, version AS edit, version * (1 + doc_id % 60) AS total_rows, (version - 1) * (1 + doc_id % 60) AS stale_rows, 2 * (1 + doc_id % 60) AS kept_rows, 1 + doc_id % 60 AS kept_stale FROM updates WHERE version % 10 = 0",
    "drift": f"{_UPDATES} SELECT n.doc_id FROM newest n LEFT JOIN known k ON n.doc_id = k.doc_id AND n.hash = k.hash WHERE k.doc_id IS NULL",
    "reconcile": f"{_UPDATES} SELECT k.doc_id, k.hash FROM known k JOIN newest n ON n.doc_id = k.doc_id AND n.hash = k.hash UNION ALL SELECT n.doc_id, n.hash FROM newest n LEFT JOIN known k ON n.doc_id = k.doc_id AND n.hash = k.hash WHERE k.doc_id IS NULL",
    "sequence_gaps": f"{_UPDATES}, s AS (SELECT doc_id, version, lag(version) OVER (PARTITION BY doc_id ORDER BY version) AS after FROM updates WHERE NOT lost) SELECT doc_id, after, version AS before FROM s WHERE version > after + 1",
    "stream_gaps": f"{_UPDATES}, s AS (SELECT doc_id, version, lag(version) OVER (PARTITION BY doc_id ORDER BY version) AS after FROM updates WHERE NOT lost) SELECT doc_id, after, version AS before FROM s WHERE version > after + 1",
    "stream_index": f"{_UPDATES} SELECT doc_id, version, hash FROM known",
    "update_rates": f"{_UPDATES} SELECT date_trunc('hour', ts) AS start, count(*) AS events FROM updates GROUP BY ALL",
    "cache_valid": "SELECT concat_ws('|', source, lang) AS key, min(doc_id) % 7 <> 0 AND max(doc_id) % 7 <> 0 AS valid FROM documents GROUP BY source, lang",
}
