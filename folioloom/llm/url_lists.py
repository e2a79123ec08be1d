"""URL filters by a temporal list join.

Dated list entries (listed or delisted at a time) become validity intervals;
every capture is judged by the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sample entries (list, key, action, time).  A key is a host, which covers its subdomains, or host/path, which covers what lies below.
ENTRIES = [
    ("adult", "blog.tionsh.example.net", "add", "2024-02-01 00:00:00"),
    ("adult", "blog.tionsh.example.net", "remove", "2024-05-01 00:00:00"),
    ("adult", "blog.tionsh.example.net", "add", "2024-09-15 12:00:00"),
    ("malware", "example.org/en", "add", "2024-11-01 00:00:00"),
    ("malware", "ththed.example.org", "add", "2024-01-01 00:00:00"),
    ("malware", "ththed.example.org", "remove", "2024-07-01 00:00:00"),
    ("phishing", "m.ththth.example.net/en", "add", "2024-03-10 06:00:00"),
    ("phishing", "www.ththhe.example.com/en", "add", "2024-06-01 00:00:00"),
    ("phishing", "www.ththhe.example.com/en", "remove", "2024-06-30 00:00:00"),
    ("spam", "cheap-pills.example.com", "add", "2023-06-01 00:00:00"),
    ("spam", "spam-farm.example.org", "add", "2023-11-20 00:00:00"),
    ("spam", "spam-farm.example.org", "remove", "2024-04-01 00:00:00"),
    ("spam", "spam-farm.example.org", "add", "2024-04-02 00:00:00"),
    ("spam", "thther.example.org", "add", "2024-08-08 08:00:00"),
]
#: Fetch times are not in ``pages``: the query's rule gives each page an hour of 2024.
FETCHED = "timestamp_seconds(1704067200 + pmod(page_id * 7919, 8784) * 3600)"


def entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "list string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))


def intervals(listed: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) of all times a key is on a list; valid_to is null while it stays.

    The entries of one key and list are its history, in order of time; of
    those at one time an addition wins, and repeated entries count once.
    Entries with a null list, key or time are ignored; keys lose their case
    and a trailing slash.
    """
    rows = listed.select("list", F.regexp_replace(F.lower("key"), "/+$", "").alias("key"), (F.col("action") == "add").alias("on"), "at").dropna(subset=["list", "key", "at"])
    state = rows.groupBy("list", "key", "at").agg(F.bool_or("on").alias("on"))
    until = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return state.withColumn("valid_to", until).where("on").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; empty if the URL has none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")


def keys(url: Column) -> Column:
    """All list keys that cover a URL: each parent domain, alone and with each leading part of the path."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), "/+$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    every = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(h != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, listed: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked and matched ("list:key", sorted, comma-joined) as of each fetch.

    A capture at the very time of an entry is under that entry.  Null or
    unparsable URLs and null times match nothing.  Equal captures are looked
    up once.  A host with a large share of all captures only makes one side of
    the join large, whose partitions AQE splits; the interval side has a row
    per period of a key.
    """
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched_at).alias("_at")).dropna().distinct()
    tried = asked.select("_url", "_at", F.explode(keys(F.col("_url"))).alias("key"))
    hits = tried.join(intervals(listed), "key").where("_at >= valid_from AND (valid_to IS NULL OR _at < valid_to)")
    found = hits.groupBy("_url", "_at").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "list", "key"))), ",").alias("matched"))
    out = captures.join(found, (captures[url] == found["_url"]) & (captures[fetched_at] == found["_at"]), "left")
    return out.select(*[captures[c] for c in captures.columns if c not in ("matched", "blocked")], F.col("_url").isNotNull().alias("blocked"), F.coalesce(found["matched"], F.lit("")).alias("matched"))


def filtered_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, fetched_at (seconds), blocked, matched of every page."""
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("fetched_at", F.expr(FETCHED))
    out = judge(captures, listed)
    return out.select("page_id", host(F.coalesce("url", F.lit(""))).alias("host"), F.unix_timestamp("fetched_at").alias("fetched_at"), "blocked", "matched")


ORACLE = f"""
WITH e(list, key, action, dated) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', TIMESTAMP '{d}')" for a, b, c, d in ENTRIES)}),
i AS (SELECT list, key, action, dated AS valid_from, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS valid_to FROM e),
p AS (
  SELECT page_id, lower(url) AS url, 1704067200 + (page_id * 7919) % 8784 * 3600 AS fetched_at,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]$', '') AS host,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS path
  FROM pages
), m AS (
  SELECT page_id, string_agg(DISTINCT list || ':' || key, ',' ORDER BY list || ':' || key) AS matched
  FROM p JOIN i ON action = 'add'
    AND (host = split_part(key, '/', 1) OR ends_with(host, '.' || split_part(key, '/', 1)))
    AND (NOT contains(key, '/') OR starts_with(path || '/', substr(key, instr(key, '/')) || '/'))
    AND make_timestamp(fetched_at * 1000000) >= valid_from AND (valid_to IS NULL OR make_timestamp(fetched_at * 1000000) < valid_to)
  GROUP BY page_id
)
SELECT page_id, host, fetched_at, matched IS NOT NULL AS blocked, coalesce(matched, '') AS matched FROM p LEFT JOIN m USING (page_id)
"""
