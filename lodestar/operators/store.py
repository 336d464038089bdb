"""Persistence without MERGE: each change is a new version of a table made by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and new; columns that either lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


replace_children = upsert  # keys: those of the parent


def update_if_changed(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], stamp: Column) -> DataFrame:
    """old with `fields` of new where any differs, and updated_at = stamp there."""
    fresh = new.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__hit"))
    joined = old.join(fresh, keys, "left")
    differs = F.lit(False)
    for f in fields:
        differs |= ~F.col(f).eqNullSafe(F.col(f"__{f}"))
    change = F.coalesce(F.col("__hit"), F.lit(False)) & differs
    had = F.col("updated_at") if "updated_at" in old.columns else F.lit(None).cast("string")
    out = joined.withColumn("__change", change).withColumn("updated_at", F.when(F.col("__change"), stamp).otherwise(had))
    return out.withColumns({f: F.when(F.col("__change"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).drop("__hit", "__change", *(f"__{f}" for f in fields))


def delete_window(log: DataFrame, user: int, now: float, seconds: float) -> DataFrame:
    """log without the user's rows of the last `seconds`."""
    return log.filter(~((F.col("user_id") == user) & (F.col("epoch_s") >= now - seconds)))


def add_missing_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns})


def fingerprint(df: DataFrame, key: str, *times: str) -> DataFrame:
    """One row that changes when the table does: count, greatest times, least and greatest key."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.max(t).alias(f"max_{t}") for t in times), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def storage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bytes of each column's values as text."""
    sums = df.agg(*(F.sum(F.octet_length(F.col(c).cast("string"))).alias(c) for c in columns))
    return sums.unpivot([], columns, "col", "bytes")


def is_stale(version: Column, current: str) -> Column:
    return ~version.eqNullSafe(F.lit(current))


def evaluation_stats(rows: DataFrame, label: str) -> DataFrame:
    n, good = F.count(F.lit(1)), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0))
    return rows.agg(n.alias("n"), good.alias("positive"), F.round(F.try_divide(good, n), 6).alias("agreement"))


def popularity(log: DataFrame) -> DataFrame:
    """user_id, item_id, popularity: positive events over the user's greatest count."""
    from pyspark.sql import Window

    got = log.groupBy("user_id", "item_id").agg(F.count_if(F.col("event").isin("like", "complete", "replay")).alias("k"))
    top = F.max("k").over(Window.partitionBy("user_id"))
    return got.select("user_id", "item_id", F.when(top > 0, F.col("k") / top).otherwise(0.0).alias("popularity"))
