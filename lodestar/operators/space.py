"""Percentile space, group similarity, pair scores and category ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.curves import correlation_similarity, cosine, duration_profile
from lodestar.functions.sequences import combined_similarity, let
from lodestar.operators.workspace import block_products

#: Weights of the groups of columns that are compared; a group without common columns drops out.
GROUPS = {
    "energy": (0.10, ("p_retailprice", "extendedprice_mean", "extendedprice_std", "extendedprice_range")),
    "timbre": (0.10, ("quantity_mean", "quantity_std", "quantity_p10", "quantity_p90")),
    "rhythm": (0.10, ("n_lines", "discount_mean", "discount_std")),
    "presence": (0.10, ("tax_mean", "tax_std", "tax_p90")),
    "size": (0.05, ("p_size",)),
}
EMBEDDING_WEIGHT, REASON_AT, MAX_REASONS = 0.30, 0.60, 4
#: Values of a column that are ordered in one task, or so.
RANGE_ROWS = 100_000
#: Groups that need the flag on both sides.
FLAGGED_GROUPS = ("presence",)


def percentiles_long(items: DataFrame, columns: list[str], key: str = "item_id") -> DataFrame:
    """key, col, value, p: share of the column's non-null values that are at most the row's.

    A column's values are cut into ranges of about RANGE_ROWS at approximate quantiles; each range is ordered by itself, and
    the numbers of values in the ranges before are added. So one shuffle serves all columns, and no task sees a whole column.
    """
    long = items.unpivot(key, columns, "col", "value").filter(F.col("value").isNotNull())
    ranges = min(10_000, -(-items.count() // RANGE_ROWS))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = F.percentile_approx("value", cuts, max(10_000, 10 * ranges)) if cuts else F.array().cast("array<double>")
    per = long.groupBy("col").agg(F.count(F.lit(1)).alias("n"), bounds.alias("bounds"))  # a row for each column
    placed = long.join(F.broadcast(per), "col").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    counts = placed.groupBy("col", "range").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("col").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("col", "range", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))  # ranges x columns rows
    within = F.count(F.lit(1)).over(Window.partitionBy("col", "range").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    got = placed.withColumn("within", within).join(F.broadcast(before), ["col", "range"])
    return got.select(key, "col", "value", ((F.col("before") + F.col("within")) / F.col("n")).alias("p"))


def space(items: DataFrame, columns: list[str], key: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Items with their percentiles in place of the values, null where the value is."""
    wide = percentiles_long(items, columns, key).groupBy(key).agg(*(F.max(F.when(F.col("col") == c, F.col("p"))).alias(c) for c in columns))
    return items.select(key, *keep).join(wide, key, "left")


def null_mean(values: list[Column]) -> Column:
    """Mean of the non-null values, null if there is none."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / n)


def clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rounded(c: Column, places: int) -> Column:
    """c to so many places as DuckDB's round() does it, scaled and then half away from zero. Spark rounds the shortest decimal
    of the unscaled value, which differs where that or the product stands on a half."""
    return F.round(c * F.lit(10.0**places)) / F.lit(10.0**places)


def group_similarity(a: str, b: str, columns: tuple[str, ...], flag: str | None = None) -> Column:
    """1 - mean difference of percentiles of two rows (column prefixes a and b) over what both have, null if that is nothing."""
    d = null_mean([F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in columns])
    s = F.when(d.isNotNull(), clip(1 - d))  # clip() alone makes 0 of null, and the group would count
    return F.when((F.col(f"{a}{flag}") == 1) & (F.col(f"{b}{flag}") == 1), s) if flag else s


def with_sequences(scalar: Column, a: Column, b: Column) -> Column:
    """A group's similarity with its sequences: half each where both have two tokens or more, else what is known."""
    seq = combined_similarity(a, b)
    both = F.coalesce((F.size(a) >= 2) & (F.size(b) >= 2), F.lit(False))
    return F.when(~both, scalar).when(scalar.isNull(), seq).otherwise(clip(0.5 * scalar + 0.5 * seq))


#: Weights of the energy curve, the sequence of section groups and the duration profile.
STRUCTURE = (0.45, 0.30, 0.25)


def structure_similarity(curves: tuple[Column, Column], groups: tuple[Column, Column], ratios: tuple[Column, Column]) -> Column:
    """Weighted mean of what is known of: correlation of energy curves, similarity of group sequences (two tokens or more
    each), correlation of duration profiles; null if nothing is. A correlation is unknown for constant curves, curves
    of different lengths, and curves that are 0 throughout."""
    alive = lambda c: F.coalesce(F.exists(c, lambda v: v != 0), F.lit(False))
    parts = F.struct(
        F.when(alive(curves[0]) & alive(curves[1]), correlation_similarity(*curves)).alias("a"), with_sequences(F.lit(None).cast("double"), *groups).alias("b"),
        correlation_similarity(duration_profile(ratios[0]), duration_profile(ratios[1])).alias("c"),
    )

    def blend(p: Column) -> Column:
        known = list(zip(STRUCTURE, (p["a"], p["b"], p["c"]), strict=True))
        total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in known), F.lit(0.0))
        return F.when(total > 0, clip(sum((F.coalesce(s * w, F.lit(0.0)) for w, s in known), F.lit(0.0)) / total))

    return let(parts, blend)


def pair_scores(pairs: DataFrame, a: str = "a_", b: str = "b_", embedding: str = "embedding") -> DataFrame:
    """Pairs with s_<group> similarities and `score`, their weighted mean over what is known, to 4 places."""
    sims = {f"s_{g}": group_similarity(a, b, cols, "flagged" if g in FLAGGED_GROUPS else None) for g, (_, cols) in GROUPS.items()}
    out = pairs.withColumns(sims | {"s_embedding": F.col(embedding)})
    weights = {"embedding": EMBEDDING_WEIGHT} | {g: w for g, (w, _) in GROUPS.items()}
    total = sum((F.when(F.col(f"s_{g}").isNotNull(), w).otherwise(0.0) for g, w in weights.items()), F.lit(0.0))
    blend = sum((F.coalesce(F.col(f"s_{g}") * w, F.lit(0.0)) for g, w in weights.items()), F.lit(0.0))
    return out.withColumn("score", rounded(F.try_divide(blend, total), 4))


def reasons() -> Column:
    """The groups that explain a scored pair: most contribution first, embedding always, others from 0.60, four at most."""
    weights = {"embedding": EMBEDDING_WEIGHT} | {g: w for g, (w, _) in GROUPS.items()}
    entries = F.array(*(F.struct((-rounded(w * F.col(f"s_{g}"), 6)).alias("c"), F.lit(g).alias("g"), F.col(f"s_{g}").alias("s")) for g, w in weights.items()))
    known = F.filter(entries, lambda e: e["s"].isNotNull() & ((e["g"] == "embedding") | (e["s"] >= REASON_AT)))
    return F.array_join(F.slice(F.transform(F.array_sort(known), lambda e: e["g"]), 1, MAX_REASONS), ",")


def resolve(items: DataFrame, targets: dict[str, float]) -> tuple[dict[str, float], list[str]]:
    """Targets whose column holds any value, and the names of the others."""
    there = [c for c in targets if c in items.columns]
    known = items.agg(*(F.count(c).alias(c) for c in there)).first().asDict() if there else {}
    return {c: targets[c] for c in there if known[c]}, [c for c in targets if not known.get(c)]


def hard_filter(conditions: dict, columns: list[str]) -> Column:
    """flagged / unflagged, <column>_min / _max (null fails, unknown columns are ignored) and <column>_is (trimmed, any case)."""
    keep = F.lit(True)
    for name, v in conditions.items():
        if name in ("flagged", "unflagged"):
            if v:
                flag = F.coalesce(F.col("flagged"), F.lit(0)) != 0
                keep &= flag if name == "flagged" else ~flag
        elif name.endswith("_min") and name[:-4] in columns:
            keep &= F.col(name[:-4]) >= F.lit(v)
        elif name.endswith("_max") and name[:-4] in columns:
            keep &= F.col(name[:-4]) <= F.lit(v)
        elif name.endswith("_is") and name[:-3] in columns:
            keep &= F.lower(F.trim(F.col(name[:-3]))) == str(v).strip().lower()
    return F.coalesce(keep, F.lit(False))


def closeness(targets: dict[str, float]) -> Column:
    """1 - mean distance of percentiles to targets over known dimensions, to 4 places; 1 without targets."""
    if not targets:
        return F.lit(1.0)
    return F.round(1 - null_mean([F.abs(F.col(c) - F.lit(t)) for c, t in targets.items()]), 4)


def rank_category(percentiles: DataFrame, targets: dict[str, float], limit: int | None = None, key: str = "item_id") -> DataFrame:
    """Rows with a known dimension by closeness, ties by key."""
    got = percentiles.withColumn("score", closeness(targets)).filter(F.col("score").isNotNull()).orderBy(F.desc("score"), key)
    return got.limit(limit) if limit else got


def support(percentiles: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Pool size, rows within a mean distance of 0.25, the least support asked for and whether it is missed."""
    d = null_mean([F.abs(F.col(c) - F.lit(t)) for c, t in targets.items()])
    got = percentiles.select(d.alias("d")).filter("d is not null").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("d") <= 0.25).alias("support"))
    least = F.greatest(F.lit(5), F.bround(F.col("pool") * 0.05, 0).cast("bigint"))
    return got.withColumn("min_support", least).withColumn("low_support", F.col("support") < F.col("min_support"))


#: Vectors and queries that meet in one task.
MEET = (8192, 2048)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """Exact top-k by inner product of any number of queries: blocks of queries meet blocks of vectors as matrix products.

    Returns query_id, item_id, similarity = (inner product + 1) / 2 between 0 and 1, rank. Neither side goes to the driver.
    """
    import numpy as np
    import pyarrow as pa

    names = ["query_id", "item_id", "ip"]
    matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().reshape(len(t), -1)

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(rows) or not len(asks):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        m, who, q, ids = matrix(rows), rows.column(key).to_numpy(), matrix(asks), asks.column("query_id").to_numpy()
        out = []
        for at in range(0, len(q), 256):
            s = q[at : at + 256] @ m.T
            s[ids[at : at + 256, None] == who[None, :]] = -np.inf
            n = min(k, s.shape[1])
            floor = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero((s >= floor - 4e-6) & np.isfinite(s))  # what rounding may make equal, too
            out.append((ids[at + i], who[j], np.cumsum(q[at + i] * m[j], axis=1)[:, -1]))  # one addition after another, as SQL has it
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    found = block_products(vectors.select(key, "vector"), queries.select("query_id", "vector"), (key, "query_id"), run, "query_id bigint, item_id bigint, ip double", MEET)
    sim = rounded(clip((F.col("ip") + 1) / 2), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.select("query_id", "item_id", sim.alias("similarity")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def similar(percentiles: DataFrame, vectors: DataFrame, seeds: DataFrame, recall: int = 200, limit: int = 20) -> DataFrame:
    """Two stages for a stated set of seeds (item_id): vector recall, then weighted re-ranking with reasons."""
    queries = vectors.join(seeds, "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "vector")
    pool = vector_topk(vectors, queries, recall).select("query_id", "item_id", F.col("similarity").alias("embedding"))
    side = lambda p, k: percentiles.select(F.col("item_id").alias(k), *(F.col(c).alias(f"{p}{c}") for c in percentiles.columns if c != "item_id"))
    pairs = pool.join(side("b_", "item_id"), "item_id").join(side("a_", "query_id"), "query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pair_scores(pairs).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).withColumn("reasons", reasons())


def deduplicate(candidates: DataFrame, limit: int, weight: float = 0.8, near: float = 0.97) -> DataFrame:
    """Greedy choice per group `list_id` of (list_id, item_id, score, vector): weight * score - (1 - weight) * greatest cosine
    with the chosen; what is nearer than `near` to a choice is out, and fills up by score if too few are left."""
    import numpy as np
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        if len(pdf) <= limit or limit <= 1:
            chosen = list(range(min(limit, len(pdf))))
        else:
            dim = next((len(v) for v in pdf.vector if v is not None), 1)
            m = np.array([v if v is not None else [0.0] * dim for v in pdf.vector], float)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            s, most, open_, chosen = pdf.score.to_numpy(), np.zeros(len(pdf)), np.ones(len(pdf), bool), []
            while len(chosen) < limit and open_.any():
                i = int(np.argmax(np.where(open_, weight * s - (1 - weight) * most, -np.inf)))
                chosen.append(i)
                cos = m @ m[i]
                most = np.maximum(most, cos)
                open_ &= most <= near
                open_[i] = False
            chosen += [i for i in range(len(pdf)) if i not in set(chosen)][: limit - len(chosen)]
        return pd.DataFrame({"list_id": pdf.list_id.iloc[chosen], "item_id": pdf.item_id.iloc[chosen], "score": pdf.score.iloc[chosen], "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("list_id").applyInPandas(pick, "list_id bigint, item_id bigint, score double, rank int")


def deduplicate_all(candidates: DataFrame, limit: int, weight: float = 0.8, near: float = 0.97) -> DataFrame:
    """The choice of `deduplicate` from one list of any length (item_id, score, vector): item_id, score, rank.

    Each step is one aggregate over the whole list, as every choice changes what the next one may be; only the chosen
    vectors, `limit` of them, reach the driver. A missing vector is near nothing.
    """
    spark = candidates.sparkSession
    rows = candidates.select("item_id", "score", "vector")
    short = rows.limit(limit + 1).count() <= limit or limit <= 1
    chosen: list = []
    while not short and len(chosen) < limit:
        near_to = [cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in r.vector)), 0.0) for r in chosen if r.vector is not None]
        most = F.coalesce(F.greatest(F.lit(0.0), *near_to), F.lit(0.0)) if near_to else F.lit(0.0)
        open_ = rows.withColumn("most", most).filter((F.col("most") <= near) & ~F.col("item_id").isin([r.item_id for r in chosen] or [None])) if chosen else rows.withColumn("most", most)
        value = F.round(weight * F.col("score") - (1 - weight) * F.col("most"), 12)
        best = open_.agg(F.min_by(F.struct("item_id", "score", "vector"), F.struct(-value, -F.col("score"), F.col("item_id"))).alias("r")).first().r
        if best is None:
            break
        chosen.append(best)
    rest = rows.filter(~F.col("item_id").isin([r.item_id for r in chosen])) if chosen else rows
    fill = rest.orderBy(F.desc("score"), "item_id").limit(limit - len(chosen)).collect() if len(chosen) < limit else []
    picked = [(r.item_id, float(r.score), i + 1) for i, r in enumerate([*chosen, *fill])]
    return spark.createDataFrame(picked, "item_id bigint, score double, rank int")
