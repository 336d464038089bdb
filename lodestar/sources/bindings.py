"""The engine's shapes (items, vectors, interactions, sequences, curves) bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.workspace import versioned

#: The clock of all bound queries, in epoch seconds: 2024-01-31 00:00:00 UTC.
NOW = 1_706_659_200
#: Fixed binding of event types to interaction names and to token letters.
EVENT_NAMES = {"purchase": "like", "signup": "complete", "click": "play", "view": "impression", "error": "skip"}
TOKENS = {"click": "a", "error": "b", "purchase": "c", "signup": "d", "view": "e"}
MEASURES = ("quantity", "extendedprice", "discount", "tax")
SCALARS = ("p_retailprice", "p_size", *(f"{m}_{s}" for m in MEASURES for s in ("mean", "std", "p10", "median", "p90", "range")), "n_lines")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`build_profile`, kept by the version of the tables it comes from."""
    return versioned(spark, "items", [f"{sf_dir}/part.parquet", f"{sf_dir}/lineitem.parquet"], lambda: build_profile(spark, sf_dir))


def build_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with its line statistics; `flagged` is 1 if over a quarter of its lines came back.

    Statistics of `tax` are null where flagged is 0, as vocal measures are without vocals.
    """
    aggs = [F.count(F.lit(1)).cast("double").alias("n_lines"), (F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)) > 0.25).cast("int").alias("flagged")]
    for m in MEASURES:
        c = F.col(f"l_{m}")
        p = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        aggs += [F.avg(c).alias(f"{m}_mean"), F.stddev_pop(c).alias(f"{m}_std"), p.alias(f"__{m}")]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*aggs)
    for m in MEASURES:
        lines = lines.withColumns({f"{m}_p10": F.col(f"__{m}")[0], f"{m}_median": F.col(f"__{m}")[1], f"{m}_p90": F.col(f"__{m}")[2], f"{m}_range": F.col(f"__{m}")[2] - F.col(f"__{m}")[0]})
    out = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    tax = {c: F.when(F.col("flagged") == 1, F.col(c)) for c in SCALARS if c.startswith("tax_")}
    return out.withColumns(tax).select(F.col("p_partkey").alias("item_id"), *(F.round(F.col(c).cast("double") + 1e-9, 6).alias(c) for c in SCALARS), F.coalesce("flagged", F.lit(0)).alias("flagged"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


ITEM_SQL = (
    "SELECT p_partkey AS item_id, " + ", ".join(f"round(CAST({'CASE WHEN flagged = 1 THEN ' + c + ' END' if c.startswith('tax_') else c} AS DOUBLE) + 1e-9, 6) AS {c}" for c in SCALARS)
    + ", coalesce(flagged, 0) AS flagged, p_brand AS brand, p_type AS type FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n_lines, CAST(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > 0.25 AS INTEGER) AS flagged, "
    + ", ".join(f"avg(l_{m}) AS {m}_mean, stddev_pop(l_{m}) AS {m}_std, quantile_cont(l_{m}, 0.1) AS {m}_p10, quantile_cont(l_{m}, 0.5) AS {m}_median, quantile_cont(l_{m}, 0.9) AS {m}_p90, quantile_cont(l_{m}, 0.9) - quantile_cont(l_{m}, 0.1) AS {m}_range" for m in MEASURES)
    + " FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, event, epoch_s (seconds), completion."""
    names = F.create_map(*(F.lit(x) for kv in EVENT_NAMES.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), names[F.col("event_type")].alias("event"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch_s"), F.least(F.lit(1.0), F.col("value") / 100).alias("completion"), "event_id",
    )


INTERACTION_SQL = (
    "SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items())
    + " END AS event, epoch_us(ts) / 1e6 AS epoch_s, least(1.0, value / 100) AS completion, event_id FROM events"
)


def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and all its events in order as an array of one-letter tokens."""
    letters = F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv))
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", letters[F.col("event_type")].alias("t"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(rows, lambda r: r["t"]).alias("tokens"))


SEQUENCE_SQL = "SELECT user_id, list(t ORDER BY ts, event_id)[1:120] AS tokens FROM (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOKENS.items()) + " END AS t FROM events) GROUP BY user_id"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day (0 to 29) and the day's sum of values over the user's greatest; days without events are 0."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    sums = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.sum("value").alias("s"))
    per = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "s"))).alias("m"), F.max("s").alias("top"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)) / F.col("top"))
    return per.select("user_id", F.transform(filled, lambda v: F.round(v, 6)).alias("curve"))


CURVE_SQL = """SELECT user_id, list(round(coalesce(s, 0.0) / top, 6) ORDER BY day) AS curve FROM (
  SELECT u.user_id, d.day, s, max(s) OVER (PARTITION BY u.user_id) AS top FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(30)) AS day) d
  LEFT JOIN (SELECT user_id, date_diff('day', date '2024-01-01', CAST(ts AS DATE)) AS day, sum(value) AS s FROM events GROUP BY 1, 2) x ON x.user_id = u.user_id AND x.day = d.day) GROUP BY user_id"""
