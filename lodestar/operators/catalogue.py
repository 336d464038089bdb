"""Lookups, overlays, tags, reports and exports of an item library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import space
from lodestar.operators.workspace import shared_dir

#: Fixed value: how a year is found in a tag.
YEAR = "(1[0-9]{3}|20[0-9]{2}|30[0-9]{2})"
#: Least share of a cluster's rows that carry a tag, and least share of them with the commonest one, to name it so.
COVERAGE, PURITY = 0.6, 0.7
#: Fixed value: what parts the elements of a sequence in an exported payload.
UNIT = "\x1f"
#: Conditions that rest on an estimate.
ESTIMATED = ("flagged", "unflagged")


def point_lookup(df: DataFrame, **keys) -> DataFrame:
    """The rows with these values; the filter reaches the scan."""
    return df.filter(_all(F.col(k) == v for k, v in keys.items()))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def vector_lengths(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """n, shortest, longest: a table of vectors is sound if the last two are equal."""
    size = F.size(column)
    return vectors.agg(F.count(column).alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


def ordered_vectors(vectors: DataFrame, key: str = "item_id", column: str = "vector") -> DataFrame:
    """All vectors in order of their key; raises if they differ in length."""
    r = vector_lengths(vectors, column).first()
    if r.n and r.shortest != r.longest:
        raise ValueError(f"vectors of {r.shortest} to {r.longest} numbers")
    return vectors.orderBy(key)


def display_list(ids: DataFrame, names: DataFrame, key: str = "item_id") -> DataFrame:
    """place, key and names' columns for a list of ids (place, key), each id once at its first place, unknown ones with nulls."""
    once = ids.groupBy(key).agg(F.min("place").alias("place"))
    return once.join(names, key, "left")


def columns_of(df: DataFrame) -> DataFrame:
    """pos, col of a table's columns."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "pos int, col string")


def overlay(presets: DataFrame, extra: DataFrame, key: str = "id") -> DataFrame:
    """Presets and extra rows, of one id the extra row."""
    both = presets.withColumn("__rank", F.lit(1)).unionByName(extra.withColumn("__rank", F.lit(0)))
    return both.withColumn("__first", F.row_number().over(Window.partitionBy(key).orderBy("__rank"))).filter("__first = 1").drop("__rank", "__first")


def listing(**sources: DataFrame) -> DataFrame:
    """Rows of all sources with the column `source` that says which."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def unscored(percentiles: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row: scored and unscored target columns in order, joined by commas."""
    got = percentiles.agg(*(F.count(c).alias(c) for c in targets))
    scored = F.filter(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in sorted(targets))), lambda c: c.isNotNull())
    every = F.array(*map(F.lit, sorted(targets)))
    return got.select(F.array_join(scored, ",").alias("scored"), F.array_join(F.array_except(every, scored), ",").alias("unscored"))


def interaction_range(log: DataFrame, user: int, since: float, most: int) -> DataFrame:
    """A user's events from `since` on, newest first, `most` at most."""
    return log.filter((F.col("user_id") == user) & (F.col("epoch_s") >= since)).orderBy(F.desc("epoch_s"), F.desc("event_id")).limit(most)


def analysis_scope(version: Column) -> Column:
    """full_track for a version that is a number, window for any other, unknown for none."""
    return F.when(version.isNull(), "unknown").when(version.rlike("^[0-9]+$"), "full_track").otherwise("window")


def completed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(_all(F.col(c).isNotNull() for c in columns))


def exclusions(given: DataFrame, recent: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id) that a caller excludes or that are in the user's recent history."""
    return given.select("user_id", "item_id").unionByName(recent.select("user_id", "item_id")).distinct()


def frame_statistics(frames: DataFrame, keys: list[str], v: str) -> DataFrame:
    """mean, std, p10, p25, p50, p75, p90, top, dynamic range (p95 - p10) and crest (top over mean) of each key's values."""
    p = F.percentile(v, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9, 0.95))))
    got = frames.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), p.alias("p"), F.max(v).alias("top"))
    named = [F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))]
    return got.select(*keys, "mean", "std", *named, "top", (F.col("p")[5] - F.col("p")[0]).alias("dynamic_range"), (F.col("top") / (F.col("mean") + 1e-9)).alias("crest"))


def tag_evidence(members: DataFrame, fields: list[str]) -> DataFrame:
    """cluster, field, value, coverage, purity: of `fields` in order the first that COVERAGE of a cluster's rows (cluster and
    these columns) carry and whose commonest value (ties: the smallest) has PURITY of them. Blank tags count as missing."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    tags = F.explode(F.array(*(F.struct(F.lit(i).alias("order"), F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for i, f in enumerate(fields))))
    n = members.select("cluster", tags.alias("t")).select("cluster", "t.*").filter("value <> ''").groupBy("cluster", "order", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("cluster", "order", "field").agg(F.sum("n").alias("tagged"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best")).join(size, "cluster")
    shares = per.select("cluster", "order", "field", F.col("best.value").alias("value"), (F.col("tagged") / F.col("size")).alias("coverage"), (-F.col("best.n") / F.col("tagged")).alias("purity"))
    good = shares.filter((F.col("coverage") >= COVERAGE) & (F.col("purity") >= PURITY))
    return good.groupBy("cluster").agg(F.min_by(F.struct("field", "value", "coverage", "purity"), "order").alias("t")).select("cluster", "t.*")


def presence(members: DataFrame, flag: str, split: float = 0.25) -> DataFrame:
    """cluster, share of its rows with the flag, and the filter that follows: unflagged, flagged or none."""
    got = members.groupBy("cluster").agg(F.avg(F.when(F.coalesce(F.col(flag), F.lit(0)) != 0, 1.0).otherwise(0.0)).alias("share"))
    return got.withColumn("filter", F.when(F.col("share") <= split, "unflagged").when(F.col("share") >= 1 - split, "flagged").otherwise(""))


def cluster_targets(long: DataFrame, clusters: DataFrame, least: float = 0.15, most: int = 3) -> DataFrame:
    """cluster, col, target: the percentile a cluster stands for in the dimensions that name it."""
    means = long.join(clusters, "item_id").groupBy("cluster", "col").agg(F.round(F.avg("p") - 0.5, 6).alias("dev"))
    by = Window.partitionBy("cluster")
    ranked = means.withColumns({"r": F.row_number().over(by.orderBy(F.desc(F.abs("dev")), "col")), "clear": F.max(F.when(F.abs("dev") >= least, 1).otherwise(0)).over(by)})
    keep = F.when(F.col("clear") == 1, (F.abs("dev") >= least) & (F.col("r") <= most)).otherwise(F.col("r") <= 2)
    return ranked.filter(keep).select("cluster", "col", F.round(F.col("dev") + 0.5 + 1e-9, 3).alias("target"))


def first_tag(*values: Column) -> Column:
    """The first value that is text and not blank, trimmed; values with a NUL are binary."""
    clean = lambda v: F.when(~F.contains(v, F.lit("\x00")) & (F.trim(v) != ""), F.trim(v))
    return F.coalesce(*map(clean, values))


def tags(df: DataFrame, title: Column, artists: list[Column], date: Column) -> DataFrame:
    """df with title, artist, year and meta_source (tag or none)."""
    out = df.withColumns({"title": first_tag(title), "artist": first_tag(*artists), "year": F.nullif(F.regexp_extract(F.coalesce(date, F.lit("")), YEAR, 1), F.lit("")).cast("int")})
    return out.withColumn("meta_source", F.when(F.coalesce("title", "artist", F.col("year").cast("string")).isNotNull(), "tag").otherwise("none"))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def label(artist: Column, title: Column, path: Column) -> Column:
    """`artist - title` as far as they are known, the file's name without a title."""
    return F.when(title.isNull(), file_name(path)).otherwise(F.concat_ws(" - ", artist, title))


def backfill(items: DataFrame, skipped: DataFrame, found: DataFrame, key: str, fields: list[str], stamp: Column) -> DataFrame:
    """items with the tags found for those of the skipped rows that had none (meta_source null or none)."""
    from lodestar.operators.store import update_if_changed

    bare = items.filter(F.coalesce("meta_source", F.lit("none")) == "none").select(key).join(skipped.select(key), key, "left_semi")
    return update_if_changed(items, found.join(bare, key, "left_semi"), [key], fields, stamp)


def export_labels(rows: DataFrame, path: str) -> None:
    """One CSV file seed, recommendation, label in order; for hand-made labels, which are few."""
    rows.select("seed", "recommendation", "label").orderBy("seed", "recommendation").coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def export_payload(items: DataFrame, columns: list[str], path: str) -> None:
    """Tab-separated lines, sequences joined by UNIT, nulls empty, numbers as text."""
    kinds = dict(items.dtypes)
    text = [F.array_join(F.transform(c, lambda v: v.cast("string")), UNIT) if kinds[c].startswith("array") else F.col(c).cast("string") for c in columns]
    items.select(F.concat_ws("\t", *(F.coalesce(t, F.lit("")) for t in text)).alias("value")).write.mode("overwrite").text(path)


class VectorIndex:
    """Vectors with their place, kept as a table; searched exactly by `space.vector_topk`."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def build(cls, vectors: DataFrame) -> VectorIndex:
        return cls(ordered_vectors(vectors).select("item_id", "vector"))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark.read.parquet(path))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return space.vector_topk(self.rows, queries, k)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"


def category_report(items: DataFrame, percentiles: DataFrame, targets: dict[str, float], conditions: dict, tag_columns: dict[str, str]) -> DataFrame:
    """One row about a request: usable and ignored targets, unknown filters, filters that rest on estimates, rows without a
    tag that is asked for, size of the pool, rows near the targets, and whether the request is refused, as nothing is
    left to rank by and nothing to filter by. Lists are in order, joined by commas; support counts rows that pass the filters.
    """
    usable, ignored = space.resolve(percentiles, targets)
    bare = lambda k: k[: -len(k.rsplit("_", 1)[-1]) - 1] if k.endswith(("_min", "_max", "_is")) else k
    unknown = sorted(k for k in conditions if k not in ESTIMATED and k not in tag_columns and bare(k) not in items.columns)
    estimated = sorted(k for k, v in conditions.items() if v and k in ESTIMATED)
    asked = sorted(c for k, c in tag_columns.items() if k in conditions)
    missing = items.agg(F.count(F.lit(1)).alias("pool"), *(F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in asked)).first()
    refused = not usable and not conditions
    pool = items.filter(space.hard_filter(conditions, items.columns)).select("item_id").join(percentiles.select("item_id", *usable), "item_id", "left")
    near = space.null_mean([F.abs(F.col(c) - t) for c, t in usable.items()]) if usable else F.lit(0.0)
    support = 0 if refused else pool.filter(near <= 0.25).count()
    least = max(5, round(0.05 * missing.pool))
    row = (",".join(usable), ",".join(ignored), ",".join(unknown), ",".join(estimated), ",".join(f"{c}:{missing[c]}" for c in asked), missing.pool, support, least, support < least, refused)
    return items.sparkSession.createDataFrame([row], "usable string, ignored string, unknown_filters string, filter_estimated string, tag_missing string, pool bigint, support bigint, min_support bigint, low_support boolean, refused boolean")


def tempo_runs(windows: DataFrame, keys: list[str], at: str, v: str, apart: float = 0.10, least: int = 2) -> DataFrame:
    """keys, start, end, mean, n of runs of `least` windows or more that differ from the key's median by more than `apart` of it;
    keys with fewer than three windows or a median of 0 have none."""
    from lodestar.operators.series import runs

    middle = windows.groupBy(*keys).agg(F.median(v).alias("__m"), F.count(v).alias("__c")).filter("__m > 0 and __c >= 3")
    away = windows.join(middle, keys).withColumn("__away", F.abs(F.col(v) - F.col("__m")) > apart * F.col("__m"))
    got = runs(away, keys, at, "__away").filter("__away").groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"))
    return got.filter(F.col("n") >= least).drop("run")


def tempo_stability(windows: DataFrame, keys: list[str], v: str) -> DataFrame:
    """keys, median, half and double of it, and whether the mean distance from it is 5 % of it at most (three windows at least)."""
    middle = windows.groupBy(*keys).agg(F.median(v).alias("m"))
    got = windows.join(middle, keys).groupBy(*keys, "m").agg(F.avg(F.abs(F.col(v) - F.col("m"))).alias("d"), F.count(v).alias("c"))
    return got.select(*keys, F.col("m").alias("median"), (F.col("m") / 2).alias("half"), (F.col("m") * 2).alias("double"), ((F.col("c") >= 3) & (F.col("m") > 0) & (F.col("d") <= 0.05 * F.col("m"))).alias("stable"))


def check_request(request: dict, enums: dict[str, tuple], one_of: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a request: values outside their list, and none of `one_of` given."""
    wrong = [f"{k}: {request[k]!r}" for k, allowed in enums.items() if k in request and request[k] not in allowed]
    return wrong + ([f"one of {', '.join(one_of)}"] if one_of and not any(request.get(k) for k in one_of) else [])
