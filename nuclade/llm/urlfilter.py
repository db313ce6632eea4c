"""URL filters as a temporal list join, in DataFrame functions only.

Dated list entries (``listed`` or ``delisted`` from a day on) become validity
intervals; every capture is joined, as of its fetch day, with the intervals of
its host's domains and its path's prefixes. The longest active pattern decides.

Scale: a capture is exploded into its few lookup keys, joined by equality and
aggregated; as its keys stay in one partition, the partial aggregate leaves one
slim row a capture before the only shuffle. A hot host is many rows of the left
side of an equality join, which AQE splits or replaces by a broadcast once the
list's measured size is under Spark's own threshold; nothing is hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pattern, verdict, change, day. A pattern is a domain, or a host with leading path segments.
ENTRIES = [
    ("ads-track.example.com", "block", "listed", "2023-11-01"),
    ("ads-track.example.com", "block", "delisted", "2024-05-01"),
    ("ads-track.example.com", "block", "listed", "2024-09-01"),
    ("free-bets.example.net", "block", "listed", "2024-02-15"),
    ("cheap-pills.example.net", "block", "listed", "2023-06-01"),
    ("spam-farm.example.org", "block", "listed", "2024-01-10"),
    ("spam-farm.example.org", "block", "delisted", "2024-11-20"),
    ("casino-win.example.net", "block", "listed", "2024-04-01"),
    ("adult-x.example.com", "block", "listed", "2023-01-01"),
    ("blog.casino-win.example.net", "allow", "listed", "2024-08-01"),
    ("adult-x.example.com/en", "allow", "listed", "2024-03-01"),
    ("adult-x.example.com/en", "allow", "delisted", "2024-06-01"),
    ("tionsh.example.net/fr", "block", "listed", "2024-07-01"),
]

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def entries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(pattern, verdict, change, day)``: the fixed list, or CSV files with these four columns and a header line.

    A verdict is ``block`` or ``allow``, a change ``listed`` or ``delisted``, a
    day ``yyyy-mm-dd``; lines that aren't so are left out.
    """
    kind = "pattern string, verdict string, change string, day string"
    rows = spark.createDataFrame(ENTRIES, kind) if path is None else spark.read.schema(kind).csv(path, header=True)
    rows = rows.withColumn("day", F.try_to_date("day") if hasattr(F, "try_to_date") else F.expr("try_cast(day as date)"))
    return rows.where("verdict in ('block', 'allow') and change in ('listed', 'delisted') and day is not null")


def intervals(listed: DataFrame) -> DataFrame:
    """``(pattern, verdict, since, until)`` of ``(pattern, verdict, change, day)``; ``until`` is excluded, null is open.

    Of several changes of one pattern and verdict on a day, ``listed`` holds.
    Rows with a null are ignored.
    """
    days = listed.dropna(subset=["pattern", "verdict", "change", "day"]).groupBy(_plain(F.col("pattern")).alias("pattern"), "verdict", "day").agg(F.max("change").alias("change"))
    in_order = Window.partitionBy("pattern", "verdict").orderBy("day")
    turns = days.withColumn("until", F.lead("day").over(in_order))
    return turns.where("change = 'listed'").select("pattern", "verdict", F.col("day").alias("since"), "until")


def _plain(pattern: F.Column) -> F.Column:
    """A pattern whose host is in lower case; paths differ in case."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))


def _keys(url: F.Column) -> tuple[F.Column, F.Column]:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    keys = F.concat(domains, F.slice(below, 2, F.size(steps)))
    return host, F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def evaluate(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """``(page_id, host, fetched, n_active, pattern, blocked)`` of each row of ``captures(page_id, url, fetched)``.

    ``pattern`` is the longest active one, null without any; of equal ones
    ``block`` wins. A url that is null or not absolute has no host, no active
    entry and isn't blocked; a null fetch day has no active entry. Repeated rows
    are each evaluated. Other columns are ignored.
    """
    host, keys = _keys(F.col("url"))
    rows = captures.select("page_id", "fetched", host.alias("host"), keys.alias("keys"), F.monotonically_increasing_id().alias("row"))
    wide = rows.select("page_id", "fetched", "host", "row", F.explode_outer("keys").alias("key"))
    spans = intervals(listed)
    active = (F.col("key") == F.col("pattern")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hits = wide.join(spans, active, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("verdict"), F.col("pattern"))))
    return (
        hits.groupBy("row", "page_id", "host", "fetched")
        .agg(F.count("pattern").alias("n_active"), best.alias("best"))
        .select("page_id", F.nullif("host", F.lit("")).alias("host"), "fetched", "n_active", F.col("best.pattern").alias("pattern"), F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"))
    )


def captures(pages: DataFrame) -> DataFrame:
    """Pages have no fetch day; theirs is day ``page_id mod 366`` of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def oracle() -> str:
    values = ",\n    ".join(f"('{p}', '{v}', '{c}', DATE '{d}')" for p, v, c, d in ENTRIES)
    return f"""
WITH listed(pattern, verdict, change, day) AS (VALUES
    {values}),
turns AS (SELECT *, lead(day) OVER (PARTITION BY pattern, verdict ORDER BY day) AS until FROM listed),
spans AS (SELECT pattern, verdict, day AS since, until FROM turns WHERE change = 'listed'),
rows_ AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
    lower(regexp_extract(url, '{HOST}', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS steps FROM pages),
keyed AS (SELECT page_id, fetched, host, list_distinct(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 1000000), '.'))
    || list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(list_slice(steps, 1, i), '/'))) AS keys FROM rows_),
wide AS (SELECT page_id, unnest(keys) AS key FROM keyed WHERE host <> ''),
hits AS (SELECT w.page_id, s.pattern, s.verdict,
    row_number() OVER (PARTITION BY w.page_id ORDER BY length(s.pattern) DESC, s.verdict DESC, s.pattern DESC) AS nth,
    count(*) OVER (PARTITION BY w.page_id) AS n
  FROM wide w JOIN keyed k USING (page_id) JOIN spans s ON s.pattern = w.key AND k.fetched >= s.since AND (s.until IS NULL OR k.fetched < s.until))
SELECT k.page_id, nullif(k.host, '') AS host, k.fetched, coalesce(h.n, 0) AS n_active, h.pattern, coalesce(h.verdict = 'block', false) AS blocked
FROM keyed k LEFT JOIN hits h ON h.page_id = k.page_id AND h.nth = 1
"""
