"""Time series on a fixed grid: gaps, smoothing, runs, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(frames: DataFrame, step: float, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """keys, bucket, time (bucket centre), mean (null if empty), n for every bucket up to each key's last."""
    b = F.floor(F.col(t) / step).cast("int")
    got = frames.groupBy(*keys, b.alias("bucket")).agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"))
    spine = got.groupBy(*keys).agg(F.max("bucket").alias("m")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("m"))).alias("bucket"))
    return spine.join(got, [*keys, "bucket"], "left").select(*keys, "bucket", ((F.col("bucket") + 0.5) * step).alias("time"), "mean", F.coalesce("n", F.lit(0)).alias("n"))


def fill_gaps(df: DataFrame, keys: list[str], at: str, v: str) -> DataFrame:
    """`filled`: v, linear between the known neighbours where null, the nearest known value at the ends."""
    w = Window.partitionBy(*keys).orderBy(at)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col(v).isNotNull(), F.col(at))
    got = df.withColumns({"__p": F.last(v, True).over(before), "__pt": F.last(mark, True).over(before), "__n": F.first(v, True).over(after), "__nt": F.first(mark, True).over(after)})
    line = F.col("__p") + (F.col("__n") - F.col("__p")) * (F.col(at) - F.col("__pt")) / (F.col("__nt") - F.col("__pt"))
    return got.withColumn("filled", F.coalesce(F.col(v), F.when(F.col("__p").isNull(), F.col("__n")).when(F.col("__n").isNull(), F.col("__p")).otherwise(line))).drop("__p", "__pt", "__n", "__nt")


def edge_window(keys: list[str], at: str, v: str, width: int, how) -> Column:
    """how(values) over `width` rows around each, the end values repeated beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(at)
    ahead, behind = width // 2, width - 1 - width // 2
    vals = F.collect_list(v).over(w.rowsBetween(-ahead, behind))
    whole = Window.partitionBy(*keys)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    first, last = F.first(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = F.array_repeat(first, F.greatest(F.lit(0), F.lit(ahead) - (place - 1)).cast("int"))
    right = F.array_repeat(last, F.greatest(F.lit(0), F.lit(behind) - (n - place)).cast("int"))
    return how(F.concat(left, vals, right))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def median_of(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def min_max(v: str, keys: list[str]) -> Column:
    """Value between the key's least and greatest, 0.5 if they are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(hi > lo, (F.col(v) - lo) / (hi - lo)).otherwise(0.5)


def rank_percent(v: str, tie: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return (F.row_number().over(w.orderBy(v, tie)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))


def runs(df: DataFrame, keys: list[str], at: str, same: str) -> DataFrame:
    """df with `run`, a number for each run of equal neighbours of column `same`."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & F.lag(at).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def high_runs(df: DataFrame, keys: list[str], at: str, v: str, least: int = 2) -> DataFrame:
    """keys, start, end, n of runs above median + half of the range."""
    limits = df.groupBy(*keys).agg((F.median(v) + 0.5 * (F.max(v) - F.min(v))).alias("limit"))
    marked = runs(df.join(limits, keys).withColumn("high", F.col(v) > F.col("limit")), keys, at, "high")
    return marked.filter("high").groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("run")


def densest_window(df: DataFrame, keys: list[str], at: str, v: str, width: int) -> DataFrame:
    """keys, start, total: the first of the whole windows of `width` rows with the greatest sum."""
    w = Window.partitionBy(*keys).orderBy(at)
    full = df.select(*keys, F.col(at).alias("start"), F.round(F.sum(v).over(w.rowsBetween(0, width - 1)), 6).alias("total"), F.count(F.lit(1)).over(w.rowsBetween(0, width - 1)).alias("__n")).filter(F.col("__n") == width)
    return full.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "start"))).filter("__r = 1").drop("__r", "__n")


def segment_means(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg_start, seg_end, mean of the points with seg_start <= t < seg_end, for segments with two points or more."""
    on = (F.col("t") >= F.col("seg_start")) & (F.col("t") < F.col("seg_end"))
    return points.join(F.broadcast(segments), on).groupBy(*keys, "seg_start", "seg_end").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")


def find_peaks(x, prominence: float, distance: int) -> list[tuple[int, float]]:
    """(index, prominence) of local maxima at least `distance` apart (greater ones first), with enough prominence."""
    n, tops, i = len(x), [], 1
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j
        i += 1
    kept: list[int] = []
    for p in sorted(tops, key=lambda p: (-x[p], p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        left = right = x[p]
        a = p
        while a >= 0 and x[a] <= x[p]:
            left = min(left, x[a])
            a -= 1
        b = p
        while b < n and x[b] <= x[p]:
            right = min(right, x[b])
            b += 1
        if (prom := float(x[p] - max(left, right))) >= prominence:
            out.append((p, prom))
    return out


def peaks(df: DataFrame, keys: list[str], at: str, v: str, prominence: float, distance: int, most: int = 3) -> DataFrame:
    """keys, at, value, prominence of each key's peaks, the `most` prominent ones; without any its greatest value, prominence 0."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable").reset_index(drop=True)
        got = sorted(find_peaks(pdf[v].to_numpy(), prominence, distance), key=lambda p: (-p[1], p[0]))[:most]
        got = got or [(int(pdf[v].to_numpy().argmax()), 0.0)]
        out = pdf.loc[[p for p, _ in got], [*keys, at]].rename(columns={at: "at"})
        return out.assign(value=[float(pdf[v][p]) for p, _ in got], prominence=[q for _, q in got])

    types = dict(df.dtypes)
    return df.select(*keys, at, v).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + f", at {types[at]}, value double, prominence double")
