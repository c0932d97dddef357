"""URL filters with dated lists.

Entries (list, policy, kind, pattern, day, action) say that a pattern joins or
leaves a list on a day.  Per pattern they become validity intervals [from, to), and
an as-of join evaluates every capture against the entries active on its day.
Everything is DataFrame functions.

Kinds and what they match: ``domain`` a host and all below it, ``host`` one host,
``prefix`` a host with the first segments of a path, ``url`` host and path whole.
The verdict of a capture is the policy of its most specific active entry: url,
then the longest prefix, host, the longest domain; among equals ``block`` wins.

The join is an equality on (kind, pattern, epoch) with the interval as a further
condition; an interval has a row for each epoch of ``EPOCH`` days it touches within
the time that the captures span, so a pattern that comes and goes often costs a
capture at most ``EPOCH`` comparisons per list.  A host with very many captures
is a skewed sort-merge join, whose large side Spark splits; the entries of a
pattern are few, one a day and list at most, after grouping.

Defined results: captures without a host match nothing (verdict ``none``); captures
that repeat id, url and time are one; entries with null fields are ignored; of an
add and a remove on one day the remove counts; an add that follows an add goes on;
no entries: every verdict is ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = 30
DAY = 86_400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without a last slash, query and fragment."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/+$", "")


def _tails(host: Column) -> Column:
    """The host and the domains above it, down to two labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _heads(host: Column, path: Column, depth: Column) -> Column:
    """Host with the first 1, 2, ... segments of the path, as deep as any entry."""
    segments = F.split(path, "/")  # the first is empty
    top = F.least(F.size(segments) - 1, depth)
    return F.when(top > 0, F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))),
                                       lambda i: F.concat(host, F.array_join(F.slice(segments, 1, i + 1), "/")))).otherwise(F.array().cast("array<string>"))


def _keys(kind: str, patterns: Column) -> Column:
    return F.transform(patterns, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, policy, kind, pattern, since, until): until is null while the entry stands."""
    names = ["list", "policy", "kind", "pattern", "day", "action"]
    e = entries.select(names).dropna()
    e = e.groupBy("list", "policy", "kind", "pattern", "day").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("added"))
    by = Window.partitionBy("list", "policy", "kind", "pattern").orderBy("day")
    e = e.withColumn("until", F.lead("day").over(by))
    return e.where("added = 1").select("list", "policy", "kind", "pattern", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: id, url, time, n_active (entries), lists (sorted, comma-joined),
    matched_kind, matched_pattern and verdict (allow, block or none).  Times are seconds."""
    c = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{time_col}`").cast("long").alias("at"))
    c = c.withColumns({"day": F.expr(f"at div {DAY}"), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = intervals(entries)
    depth = known.where("kind = 'prefix'").select(F.max(F.size(F.split("pattern", "/")) - 1).alias("d")).scalar()
    first, last = c.select(F.min("day")).scalar(), c.select(F.max("day")).scalar()
    lo, hi = F.greatest("since", first), F.least(F.coalesce(F.col("until") - 1, last), last)
    spread = known.where(lo <= hi).withColumn("epoch", F.explode(F.sequence(
        F.floor(lo / EPOCH).cast("long"), F.floor(hi / EPOCH).cast("long"))))
    keys = F.concat(_keys("host", F.array("host")), _keys("domain", _tails(F.col("host"))),
                    _keys("url", F.array(F.concat("host", "path"))), _keys("prefix", _heads(F.col("host"), F.col("path"), F.col("depth"))))
    asked = c.where("host != ''").withColumn("depth", F.coalesce(depth, F.lit(0))).select("id", "url", "at", "day", F.explode(keys).alias("key"))
    asked = asked.select("id", "url", "at", "day", "key.kind", "key.pattern", F.floor(F.col("day") / EPOCH).cast("long").alias("epoch"))
    rank = F.when(F.col("kind") == "url", 4).when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1)
    found = asked.join(spread, ["kind", "pattern", "epoch"]).where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    found = found.select("id", "url", "at", F.struct("list", "policy", "kind", "pattern").alias("entry"),
                         F.struct(rank.alias("rank"), F.length("pattern").alias("length"), "policy", "kind", "pattern").alias("weight"))
    none = c.select("id", "url", "at", F.lit(None).cast(found.schema["entry"].dataType).alias("entry"), F.lit(None).cast(found.schema["weight"].dataType).alias("weight"))
    # a capture without a match keeps its row: every capture is in the union once without an entry
    best = none.union(found).groupBy("id", "url", "at").agg(F.collect_set("entry").alias("active"), F.max("weight").alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), F.size("active").cast("long").alias("n_active"),
                       F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda x: x["list"]))), ",").alias("lists"),
                       F.col("best.kind").alias("matched_kind"), F.col("best.pattern").alias("matched_pattern"),
                       F.coalesce("best.policy", F.lit("none")).alias("verdict"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time within a year, by a rule of the id."""
    return pages.select("page_id", "url", (F.lit(1_704_067_200) + F.col("page_id") * 7_919 % 31_536_000).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """An entry for every page: its host, domain, path prefix or whole url joins
    or leaves one of three lists on a day of that year, by rules of the id."""
    i, host, path = F.col("page_id"), host_of(F.col("url")), path_of(F.col("url"))
    kind = F.element_at(F.array(*map(F.lit, ("host", "domain", "prefix", "url"))), (i % 4 + 1).cast("int"))
    pattern = (F.when(kind == "host", host).when(kind == "domain", F.substring_index(host, ".", -2))
               .when(kind == "prefix", F.concat(host, F.lit("/"), F.element_at(F.split(F.concat(path, F.lit("/")), "/"), 2))).otherwise(F.concat(host, path)))
    return pages.select(F.concat(F.lit("list"), (i % 3).cast("string")).alias("list"), F.when(i % 3 == 0, "allow").otherwise("block").alias("policy"),
                        kind.alias("kind"), pattern.alias("pattern"), (F.lit(19_723) + i * 104_729 % 365).alias("day"),
                        F.when(F.expr("page_id div 12") % 3 == 2, "remove").otherwise("add").alias("action"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(page_captures(pages), page_entries(pages))


SQL = rf"""
WITH p AS (
  SELECT DISTINCT page_id, url, 1704067200 + page_id * 7919 % 31536000 AS fetched,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '\.$', '') AS host,
         regexp_replace(regexp_extract(coalesce(url, ''), '{PATH}', 1), '/+$', '') AS path
  FROM pages),
e AS (
  SELECT 'list' || (page_id % 3) AS list, CASE WHEN page_id % 3 = 0 THEN 'allow' ELSE 'block' END AS policy,
         (['host', 'domain', 'prefix', 'url'])[page_id % 4 + 1] AS kind,
         CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN array_to_string(string_split(host, '.')[-2:], '.')
              WHEN 2 THEN host || '/' || string_split(path || '/', '/')[2] ELSE host || path END AS pattern,
         19723 + page_id * 104729 % 365 AS day, CASE WHEN (page_id // 12) % 3 = 2 THEN 0 ELSE 1 END AS added
  FROM p WHERE page_id IS NOT NULL),
d AS (SELECT list, policy, kind, pattern, day, min(added) AS added FROM e GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, policy, kind, pattern ORDER BY day) AS until FROM d),
k AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS pattern FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 'url', host || path FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 'domain', unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
              lambda i : array_to_string(string_split(host, '.')[i:], '.'))) FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 'prefix', unnest(list_transform(range(1, len(string_split(path, '/'))),
              lambda i : host || array_to_string(string_split(path, '/')[1:i + 1], '/'))) FROM p WHERE host <> ''),
m AS (
  SELECT DISTINCT k.page_id, k.url, k.fetched, v.list, v.policy, v.kind, v.pattern,
         CASE v.kind WHEN 'url' THEN 4 WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS rnk
  FROM k JOIN v ON k.kind = v.kind AND k.pattern = v.pattern AND v.added = 1
   AND k.fetched // 86400 >= v.day AND (v.until IS NULL OR k.fetched // 86400 < v.until)),
b AS (
  SELECT page_id, url, fetched, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
         max(row(rnk, length(pattern), policy, kind, pattern)) AS best
  FROM m GROUP BY page_id, url, fetched)
SELECT p.page_id, p.url, p.fetched, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(lists, '') AS lists,
       best[4] AS matched_kind, best[5] AS matched_pattern, coalesce(best[3], 'none') AS verdict
FROM p LEFT JOIN b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.url IS NOT DISTINCT FROM b.url AND p.fetched IS NOT DISTINCT FROM b.fetched
"""
