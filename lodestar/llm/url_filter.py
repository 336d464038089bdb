"""URL filters that change over time: dated list entries become intervals, captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._shared import maybe_in, settle, steps


def host(url: Column) -> Column:
    """Lower-case host of a URL with a scheme, without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, valid_from, valid_to (exclusive, null = open) from entries (kind, value, action, day).

    An entry holds from the day of an `add` to the next day with an action on it; adding what is listed changes nothing.
    On one day an add comes before a remove, so both together leave the entry out. Entries with a null or another action are
    ignored. Days are dates, so that one value has no more distinct entries than there are days.
    """
    known = entries.filter(F.col("action").isin("add", "remove") & F.col("value").isNotNull() & F.col("day").isNotNull() & F.col("kind").isin("host", "domain"))
    days = known.select("kind", F.lower("value").alias("value"), "day", (F.col("action") == "remove").alias("gone")).groupBy("kind", "value", "day").agg(F.max("gone").alias("gone"))
    order = Window.partitionBy("kind", "value").orderBy("day")
    turns = days.withColumn("was", F.lag("gone").over(order)).filter(~F.col("gone").eqNullSafe(F.coalesce("was", F.lit(True))))
    return turns.select("kind", "value", F.col("day").alias("valid_from"), F.lead("day").over(order).alias("valid_to"), "gone").filter(~F.col("gone")).drop("gone")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, day, blocked, n_active (entries active on the day of the fetch), since (their earliest start).

    captures (page_id, url, day): `host` entries match a URL's host, `domain` entries it and all below it. One row per
    row of captures. Null or malformed URLs and null days match nothing. Rows are first reduced to distinct pairs of host
    and day, so a host of many captures costs one as-of lookup per day; the verdicts are then joined to the rows. Both
    sides of either join are settled tables, so that adaptive execution can split a hot key. Of a host's names (itself and
    all domains above it) only those that an entry names, or that look so in a bitmap, are shuffled. Other columns are not
    read; repeated rows are judged each; an empty table or list gives an empty result or no match; URLs may be of any length.
    """
    with steps() as kept:
        return _judged(captures, entries, kept)


def _judged(captures: DataFrame, entries: DataFrame, kept: list) -> DataFrame:
    own = settle(captures.select("page_id", "url", "day", host(F.col("url")).alias("host")))
    asked = own.filter("host <> '' and day is not null").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    spans = settle(intervals(entries))
    keys = asked.select("host", "day", F.explode(F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"))), suffixes)).alias("key")).select("host", "day", "key.*")
    keys = settle(maybe_in(keys, spans.select("value").distinct(), "value").filter("maybe").drop("maybe"))
    as_of = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    active = keys.join(spans.hint("merge"), ["kind", "value"]).filter(as_of)
    verdicts = settle(active.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n_active"), F.min("valid_from").alias("since")))
    kept += [own, verdicts]
    out = own.join(verdicts.hint("merge"), ["host", "day"], "left")
    return out.select("page_id", "url", "day", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "since")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on a day of 2024 given by page_id, against a list made by rule from the pages' hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 7 % 366 as int))").alias("day"))
    names = pages.select(host(F.col("url")).alias("host")).distinct().filter("host <> ''").withColumn("k", F.expr("length(host) * 7 + ascii(host) * 13"))
    first, last = F.expr("date_add(date'2024-01-01', cast(k * 5 % 200 as int))"), F.expr("date_add(date'2024-01-01', cast(k * 5 % 200 + 90 as int))")
    hosts = names.filter("k % 3 = 0").select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.explode(F.array(F.struct(F.lit("add").alias("action"), first.alias("day")), F.struct(F.lit("remove").alias("action"), last.alias("day")))).alias("e")).select("kind", "value", "e.*")
    above = names.filter("k % 4 = 1").select(F.lit("domain").alias("kind"), F.expr("regexp_replace(host, '^[^.]*[.]', '')").alias("value"), F.lit("add").alias("action"), last.alias("day"))
    return judge(pages, hosts.unionByName(above))


OP4_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(date '2024-01-01' + CAST(page_id * 7 % 366 AS INTEGER) AS DATE) AS day,
  regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '') AS host FROM pages),
n AS (SELECT DISTINCT host, length(host) * 7 + ascii(host) * 13 AS k FROM p WHERE host <> ''),
i AS (SELECT 'host' AS kind, host AS value, CAST(date '2024-01-01' + CAST(k * 5 % 200 AS INTEGER) AS DATE) AS f, CAST(date '2024-01-01' + CAST(k * 5 % 200 + 90 AS INTEGER) AS DATE) AS t FROM n WHERE k % 3 = 0
  UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]*[.]', ''), CAST(min(date '2024-01-01' + CAST(k * 5 % 200 + 90 AS INTEGER)) AS DATE), NULL FROM n WHERE k % 4 = 1 GROUP BY 2)
SELECT page_id, url, day, count(value) > 0 AS blocked, count(value) AS n_active, min(f) AS since
FROM (SELECT p.*, i.value, i.f FROM p LEFT JOIN i ON p.day >= i.f AND (i.t IS NULL OR p.day < i.t)
  AND ((i.kind = 'host' AND p.host = i.value) OR (i.kind = 'domain' AND (p.host = i.value OR ends_with(p.host, '.' || i.value))))) AS x
GROUP BY page_id, url, day
"""
