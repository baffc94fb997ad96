"""URL filters by dated lists.

Dated list entries become validity intervals; an as-of join evaluates every capture against the entries that were
active when it was fetched. The most specific active entry decides. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomry.llm.common import BROADCAST_ROWS, small_side, stored

#: Scheme, user, host, port and path of a URL.
URL = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:@]*)(?::\d*)?([^?#]*)"
#: A list key that more captures than this ask for is joined in several parts.
HOT_ROWS = 500_000


def host(url: Column) -> Column:
    """The host in lower case, without port, user and final dots; null if there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit("."))
    return F.when(found != "", found)


def segments(path: Column) -> Column:
    """The path's segments that aren't empty."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of a dated list: pattern, action, labels, depth, since, until (null: still valid).

    ``entries`` has pattern (``host`` or ``host/path``; it holds for subdomains and below the path), action (block or
    allow), change (add or remove) and at (timestamp). An entry is valid from an add up to its next change; of
    changes at one moment an add counts. Rows with a null or with a pattern without host count for nothing; repeated
    rows count once.
    """
    parts = F.split(F.trim("pattern"), "/", 2)
    name = F.rtrim(F.lower(parts[0]), F.lit("."))
    path = segments(F.coalesce(F.get(parts, 1), F.lit("")))
    rows = entries.where("pattern is not null and action is not null and change is not null and at is not null")
    rows = rows.select(name.alias("name"), path.alias("path"), "action", "at", (F.col("change") == "add").alias("on")).where("name <> ''")
    rows = rows.select(F.array_join(F.concat(F.array("name"), "path"), "/").alias("pattern"), F.size(F.split("name", r"\.")).alias("labels"), F.size("path").alias("depth"), "action", "at", "on")
    rows = rows.groupBy("pattern", "labels", "depth", "action", "at").agg(F.max("on").alias("on"))
    until = F.lead("at").over(Window.partitionBy("pattern", "action").orderBy("at"))
    return rows.withColumn("until", until).where("on").select("pattern", "action", "labels", "depth", F.col("at").alias("since"), "until")


def _keys(url: Column, labels: int, depth: int) -> Column:
    """The patterns that hold for a URL, as far as a list of this many host labels and path segments can have them."""
    names, path = F.split(host(url), r"\."), segments(F.regexp_extract(url, URL, 2))
    n = F.size(names)
    tails = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(names, n - k + 1, k), "."))
    heads = F.transform(F.sequence(F.lit(0), F.least(F.size(path), F.lit(depth))), lambda k: F.array_join(F.concat(F.array(F.lit("")), F.slice(path, 1, k)), "/"))
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, h))))


def _active(asked: DataFrame, history: DataFrame, limit: int, hot_rows: int) -> DataFrame:
    """The as-of join of (key, url, fetched_at) with the intervals.

    A list of at most ``limit`` intervals is broadcast. A longer one is joined by key; keys that very many captures ask
    for are split by a salt, with as many copies of their few intervals.
    """
    within = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    history = history.withColumnRenamed("pattern", "key")
    sized = small_side(history, limit)
    if sized is not history:
        return asked.join(sized, "key").where(within)
    counts = asked.groupBy("key").count().where(F.col("count") > hot_rows)
    hot = small_side(stored(counts.select("key", F.ceil(F.col("count") / hot_rows).cast("int").alias("copies")), "hot"), limit)
    copies = F.coalesce("copies", F.lit(1))
    left = asked.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at"), copies).cast("int")).drop("copies")
    right = history.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return left.join(right, ["key", "salt"]).where(within)


def evaluate(captures: DataFrame, entries: DataFrame, limit: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``captures`` (url, fetched_at timestamp) with blocked, pattern, action, listed_since, listed_until.

    Of the entries active at ``fetched_at`` the one with the longest host decides, then the one with the longest path, then
    an allow before a block; ``blocked`` is whether it blocks. Without an active entry, or with a null or
    unreadable url or a null time, blocked is false and the rest null. Repeated captures are evaluated once and
    get one result; other columns stay, and columns named like the added ones are replaced. Empty tables do no harm.
    ``entries``: see ``intervals``.
    """
    added = ["blocked", "pattern", "action", "listed_since", "listed_until"]
    captures = captures.drop(*added)
    history = stored(intervals(entries), "intervals")
    most = history.agg(F.max("labels").alias("labels"), F.max("depth").alias("depth")).first()
    pairs = captures.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    asked = pairs.withColumn("key", F.explode(_keys(F.col("url"), most.labels or 1, most.depth or 0)))
    best = F.max_by(F.struct("key", "action", "since", "until"), F.struct("labels", "depth", F.col("action") == "allow"))
    found = _active(asked, history, limit, hot_rows).groupBy("url", "fetched_at").agg(best.alias("best"))
    found = stored(found.select(F.col("url").alias("_url"), F.col("fetched_at").alias("_at"), "best"), "verdicts")
    out = captures.join(small_side(found, limit), (F.col("url") == F.col("_url")) & (F.col("fetched_at") == F.col("_at")), "left")
    blocked = F.coalesce(F.col("best.action") == "block", F.lit(False))
    columns = [captures[c] for c in captures.columns]
    return out.select(*columns, blocked.alias("blocked"), F.col("best.key").alias("pattern"), F.col("best.action").alias("action"), F.col("best.since").alias("listed_since"), F.col("best.until").alias("listed_until"))


def allowed(captures: DataFrame, entries: DataFrame, **options) -> DataFrame:
    """The captures that no entry active at their fetch blocks, with their own columns."""
    return evaluate(captures, entries, **options).where(~F.col("blocked")).select(*captures.columns)


#: The list of the query's own: pattern, action, change, day.
LISTED = (
    ("spam-farm.example.org", "block", "add", "2024-01-01"),
    ("spam-farm.example.org", "block", "remove", "2024-05-01"),
    ("spam-farm.example.org", "block", "add", "2024-09-15"),
    ("www.spam-farm.example.org/en", "allow", "add", "2024-03-01"),
    ("adult-x.example.com", "block", "add", "2023-06-01"),
    ("cheap-pills.example.net", "block", "add", "2024-01-15"),
    ("cheap-pills.example.net", "block", "remove", "2024-04-15"),
    ("cheap-pills.example.net", "block", "add", "2024-08-01"),
    ("ads-track.example.com/de", "block", "add", "2024-02-10"),
    ("casino-win.example.net", "block", "add", "2024-01-01"),
    ("casino-win.example.net/fr", "allow", "add", "2024-06-01"),
    ("casino-win.example.net/fr", "allow", "remove", "2024-10-01"),
    ("free-bets.example.net", "block", "add", "2024-04-01"),
    ("free-bets.example.net", "block", "remove", "2024-04-30"),
)
#: Days after 2024-01-01, times a host's number, of the changes of hosts that a rule lists: add, remove, add.
CHANGES = (("add", 0), ("remove", 45), ("add", 90))


def listed_hosts(captures: DataFrame) -> DataFrame:
    """A dated list that grows with the corpus: one host in eight, by its digest, is blocked, released and blocked again."""
    number = F.conv(F.substring(F.md5("pattern"), 1, 2), 16, 10).cast("int")
    hosts = captures.select(host(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    day = lambda more: F.date_add(F.lit("2024-01-01").cast("date"), F.col("number") * 7 + more).cast("timestamp")
    changes = F.array(*[F.struct(F.lit("block").alias("action"), F.lit(c).alias("change"), day(more).alias("at")) for c, more in CHANGES])
    return hosts.withColumn("number", number).where("number < 32").select("pattern", F.inline(changes))


#: evaluate() over ``pages``, as the query calls it.
SQL = (
    r"""
WITH fixed(pattern, action, change, day) AS (VALUES """
    + ", ".join(f"('{p}', '{a}', '{c}', '{d}')" for p, a, c, d in LISTED)
    + r"""),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 37) % 366 AS INT)) AS fetched_at,
         rtrim(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:@]*)(?::\d*)?([^?#]*)', 1)), '.') AS host,
         list_filter(string_split(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:@]*)(?::\d*)?([^?#]*)', 2), '/'), lambda x: x <> '') AS path
  FROM pages),
hosts AS (
  SELECT host AS pattern, CAST('0x' || substr(md5(host), 1, 2) AS INT) AS number FROM (SELECT DISTINCT host FROM captures WHERE host <> '')),
entries AS (
  SELECT pattern, action, change, CAST(day AS TIMESTAMP) AS moment FROM fixed
  UNION ALL
  SELECT pattern, 'block', change, TIMESTAMP '2024-01-01' + to_days(number * 7 + more)
  FROM hosts, (VALUES ('add', 0), ('remove', 45), ('add', 90)) AS c(change, more) WHERE number < 32),
moments AS (SELECT pattern, action, moment, bool_or(change = 'add') AS valid FROM entries GROUP BY ALL),
history AS (
  SELECT * FROM (SELECT *, LEAD(moment) OVER (PARTITION BY pattern, action ORDER BY moment) AS until FROM moments) WHERE valid),
sized AS (
  SELECT pattern, action, moment AS since, until, len(string_split(string_split(pattern, '/')[1], '.')) AS labels,
         len(string_split(pattern, '/')) - 1 AS depth FROM history),
tails AS (
  SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM captures WHERE host <> ''),
keys AS (
  SELECT *, array_to_string(string_split(host, '.')[k:], '.') AS tail, unnest(range(0, len(path) + 1)) AS d FROM tails),
found AS (
  SELECT page_id, url, fetched_at, s.*,
         ROW_NUMBER() OVER (PARTITION BY page_id, url, fetched_at ORDER BY labels DESC, depth DESC, s.action) AS r
  FROM keys JOIN sized s
    ON s.pattern = CASE WHEN d = 0 THEN tail ELSE tail || '/' || array_to_string(path[1:d], '/') END
   AND fetched_at >= since AND (until IS NULL OR fetched_at < until))
SELECT c.page_id, c.url, CAST(c.fetched_at AS TIMESTAMP) AS fetched_at, COALESCE(f.action = 'block', FALSE) AS blocked,
       f.pattern, f.action, f.since AS listed_since, f.until AS listed_until
FROM captures c LEFT JOIN (SELECT * FROM found WHERE r = 1) f ON c.page_id = f.page_id AND c.url = f.url AND c.fetched_at = f.fetched_at
"""
)
