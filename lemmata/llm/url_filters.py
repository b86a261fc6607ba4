"""URL filters from dated list entries.

A list says on which day a pattern was added to or removed from it. Entries
become validity intervals, and each capture is judged by those that were active
on the day it was fetched: an as-of join on the keys that a URL can match.

A pattern is a ``host`` (that host alone), a ``domain`` (with all hosts below
it) or a ``prefix`` (a host and the beginning of a path, whole segments). A
capture is blocked if a ``block`` pattern is active for it and no ``allow``
pattern is.

A URL has a key for each label of its host and each segment of its path, so
rows grow by that factor only, and only keys that some list names are joined
on. Equal captures are judged once; the join may be split where one host holds
much of the table.

Defined results: a null URL, or one without a host, matches nothing; a null day
matches nothing; entries with a null part are ignored; of entries for a pattern
on one day an addition counts last; repeated rows each get their own (equal)
result; other columns are ignored; an empty table gives an empty result. A URL of
any length has one key for each of its parts, each up to as long as the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: (list, kind, pattern, action, day)
LIST = [
    ("block", "domain", "adult-x.example.com", "add", "2024-01-01"),
    ("block", "domain", "cheap-pills.example.com", "add", "2024-03-15"),
    ("block", "domain", "cheap-pills.example.com", "remove", "2024-09-01"),
    ("block", "domain", "cheap-pills.example.com", "add", "2025-02-01"),
    ("block", "domain", "free-bets.example.com", "add", "2024-06-01"),
    ("block", "host", "spam-farm.example.org", "add", "2023-12-01"),
    ("block", "domain", "spam-farm.example.org", "add", "2024-07-01"),
    ("block", "prefix", "ads-track.example.org/en", "add", "2024-05-01"),
    ("block", "prefix", "ads-track.example.org/en", "remove", "2025-05-01"),
    ("allow", "prefix", "free-bets.example.com/de", "add", "2024-10-01"),
    ("allow", "host", "www.adult-x.example.com", "add", "2025-01-01"),
    ("allow", "host", "www.adult-x.example.com", "remove", "2025-01-01"),
]


def host(url: Column) -> Column:
    """The host, lower-cased, without user, port and final dot."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(F.lower(h), F.lit("."))


def keys(url: Column) -> Column:
    """(kind, pattern) of all patterns that would match."""
    h = host(url)
    labels = F.split(h, r"\.")
    path = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", h, F.slice(segments, 1, i)).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), h.alias("pattern")))
    return F.when(h != "", F.array_distinct(F.concat(own, domains, prefixes))).otherwise(F.slice(own, 1, 0))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, start, stop): active from ``start`` on and before
    ``stop``, which is null for what is still active."""
    clean = entries.dropna(subset=["list", "kind", "pattern", "action", "day"]).withColumn("day", F.col("day").cast("date"))
    by = Window.partitionBy("list", "kind", "pattern").orderBy("day", F.desc("action"))
    return clean.withColumn("stop", F.lead("day").over(by)).where("action = 'add' and (stop is null or stop > day)").select("list", "kind", "pattern", F.col("day").alias("start"), "stop")


def judge(captures: DataFrame, entries: DataFrame, id_column: str, url: str, day: str) -> DataFrame:
    """(id, url, day, n_active, blocked, since) of every capture; ``since`` is
    the latest start among the active block entries."""
    rows = captures.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(day).cast("date").alias("day"))
    units = rows.select("url", "day").distinct()
    active = intervals(entries).withColumnRenamed("pattern", "_p").withColumnRenamed("kind", "_k")
    asked = units.select("url", "day", F.explode(keys(F.col("url"))).alias("x")).select("url", "day", "x.kind", "x.pattern")
    hit = asked.join(active, (F.col("pattern") == F.col("_p")) & (F.col("kind") == F.col("_k")) & (F.col("start") <= F.col("day")) & (F.col("stop").isNull() | (F.col("day") < F.col("stop"))))
    block = F.col("list") == "block"
    verdict = hit.groupBy("url", "day").agg(
        F.count("*").alias("n_active"),
        (F.max(block) & ~F.coalesce(F.max(F.col("list") == "allow"), F.lit(False))).alias("blocked"),
        F.max(F.when(block, F.col("start"))).alias("since"),
    )
    verdict = written(verdict, "verdicts").select(F.col("url").alias("_u"), F.col("day").alias("_d"), "n_active", "blocked", "since")
    out = rows.join(verdict, (F.col("url") == F.col("_u")) & (F.col("day") == F.col("_d")), "left")
    return out.select("id", "url", "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("blocked", F.lit(False)).alias("blocked"), "since")


def fetched(page_id: Column) -> Column:
    """The tables have no fetch days; this deals them over two years."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.pmod(page_id, F.lit(730)) * 7919, F.lit(730)).cast("int"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(LIST, "list string, kind string, pattern string, action string, day string")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched(F.col("page_id")).alias("fetched"))
    out = judge(captures, entries, "page_id", "url", "fetched")
    return out.select(F.col("id").alias("page_id"), host(F.col("url")).alias("host"), F.col("day").alias("fetched"), "n_active", "blocked", "since")


SQL = f"""
WITH l(list, kind, pattern, action, day) AS (VALUES {", ".join(f"('{a}', '{k}', '{p}', '{x}', DATE '{d}')" for a, k, p, x, d in LIST)}),
s AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day, action DESC) AS stop FROM l),
i AS (SELECT list, kind, pattern, day AS start, stop FROM s WHERE action = 'add' AND (stop IS NULL OR stop > day)),
p AS (
  SELECT page_id, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1) AS path, (DATE '2024-01-01' + (page_id * 7919 % 730)::INT)::DATE AS fetched
  FROM pages),
h AS (
  SELECT p.*, i.list, i.start FROM p JOIN i ON start <= fetched AND (stop IS NULL OR fetched < stop) AND CASE kind
    WHEN 'host' THEN host = pattern
    WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
    ELSE starts_with(host || regexp_replace(path, '/+', '/', 'g') || '/', pattern || '/') END),
v AS (SELECT page_id, count(*) AS n, bool_or(list = 'block') AND NOT bool_or(list = 'allow') AS blocked, max(start) FILTER (list = 'block') AS since FROM h GROUP BY page_id)
SELECT page_id, host, fetched, coalesce(n, 0)::BIGINT AS n_active, coalesce(blocked, false) AS blocked, since FROM p LEFT JOIN v USING (page_id)
"""
