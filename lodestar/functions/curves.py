"""Correlation and resampling of array-valued curves, and vector products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.sequences import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def unit(a: Column) -> Column:
    """Vector of length 1; null if its length is 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of equally long arrays, null if either is constant or lengths differ."""

    def centred(p: Column) -> Column:
        n = F.size(p["a"]).cast("double")
        mean = F.struct((_total(p["a"]) / n).alias("a"), (_total(p["b"]) / n).alias("b"))
        return let(mean, lambda m: F.struct(F.transform(p["a"], lambda x: x - m["a"]).alias("a"), F.transform(p["b"], lambda x: x - m["b"]).alias("b")))

    def ratio(z: Column) -> Column:
        sums = F.struct(dot(z["a"], z["a"]).alias("a"), dot(z["b"], z["b"]).alias("b"), dot(z["a"], z["b"]).alias("ab"))
        return let(sums, lambda s: F.when((s["a"] > 1e-12) & (s["b"] > 1e-12), s["ab"] / F.sqrt(s["a"] * s["b"])))

    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda p: F.when((F.size(p["a"]) == F.size(p["b"])) & (F.size(p["a"]) > 1), let(let(p, centred), ratio)))


def correlation_similarity(a: Column, b: Column) -> Column:
    """(r + 1) / 2 between 0 and 1."""
    return let(pearson(a, b), lambda r: F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (r + 1) / 2))))


def duration_profile(ratios: Column, points: int = 8) -> Column:
    """Cumulative shares at `points` even positions, linear between the given ones; null without positive shares."""

    def profile(sums: Column) -> Column:
        n, total = F.size(sums), F.element_at(sums, -1)

        def at(k: Column) -> Column:
            place = k * (n - 1) / F.lit(points - 1.0)
            low = F.least(F.floor(place).cast("int"), F.greatest(n - 2, F.lit(0)))
            left, right = F.get(sums, low), F.coalesce(F.get(sums, low + 1), F.get(sums, low))
            return (left + (right - left) * (place - low)) / total

        return F.when((n > 0) & (total > 0), F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))

    first = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"), (acc["sum"] + x).alias("sum"))
    return F.when(F.size(ratios) > 0, let(F.aggregate(ratios, first, step, lambda acc: acc["out"]), profile))


def energy_bins(values: Column, bins: int = 64) -> Column:
    """Means over even runs of a series, over the greatest of them."""
    n = F.size(values)
    edge = lambda i: F.floor(i * n / F.lit(float(bins))).cast("int")
    mean = lambda i: F.when(edge(i + 1) > edge(i), F.aggregate(F.slice(values, edge(i) + 1, edge(i + 1) - edge(i)), F.lit(0.0), lambda acc, x: acc + x) / (edge(i + 1) - edge(i))).otherwise(0.0)
    means = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), mean)
    top = F.array_max(means)
    return F.when(top > 0, F.transform(means, lambda m: m / top)).otherwise(means)
