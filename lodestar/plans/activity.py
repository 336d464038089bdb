"""Interest, feeds, time series, persistence and text on the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as ft
from lodestar.operators import interest, series, space, store
from lodestar.plans.retrieval import COLUMNS, LONG_SQL, SPACE_SQL, _space
from lodestar.sources import bindings as b
from lodestar.sources.files import scan_status

NOW = float(b.NOW)
LOG = f"log AS ({b.INTERACTION_SQL})"
_CASE = lambda k, other: "CASE event " + " ".join(f"WHEN '{e}' THEN {v[k]}" for e, v in interest.EVENTS.items()) + f" ELSE {other} END"
WEIGHT_SQL = f"{_CASE(0, 0.0)} * CASE WHEN event = 'play' THEN coalesce(completion, 1.0) ELSE 1.0 END * exp(-greatest(0.0, {NOW} - epoch_s) / {_CASE(1, interest.OTHER_TAU)})"
SCOPE_CTE = f"WITH {LOG}, sw AS (SELECT user_id, scope, item_id, sum({WEIGHT_SQL}) AS w FROM log JOIN (VALUES " + ", ".join(f"('{s}', {w}, {lam})" for s, (w, lam) in interest.SCOPES.items()) + f") sc(scope, win, lam) ON {NOW} - epoch_s <= win GROUP BY 1, 2, 3)"
VECTOR_CTE = SCOPE_CTE + ", vs AS (SELECT user_id, scope, pos, sum(w * x) AS x FROM (SELECT user_id, scope, w, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM sw JOIN embeddings ON vec_id = item_id WHERE abs(w) > 1e-9) GROUP BY 1, 2, 3), vu AS (SELECT user_id, scope, CAST(pos AS INTEGER) AS pos, x / sqrt(sum(x * x) OVER (PARTITION BY user_id, scope)) AS x FROM vs)"


def decay_weight(spark, sf):
    return b.interactions(spark, sf).select("event_id", F.round(interest.event_weight(NOW), 6).alias("w"))


def _weights(spark, sf) -> DataFrame:
    return interest.scope_weights(b.interactions(spark, sf), NOW)


def scope_weights(spark, sf):
    return _weights(spark, sf).withColumn("w", F.round("w", 6))


def interest_vector(spark, sf):
    return interest.interest_vectors(_weights(spark, sf), b.vectors(spark, sf)).withColumn("x", F.round("x", 6))


def interest_blend(spark, sf):
    got = interest.interest_blend(interest.interest_vectors(_weights(spark, sf), b.vectors(spark, sf)))
    return got.select("user_id", F.posexplode("vector").alias("pos", "v")).select("user_id", "pos", F.round("v", 5).alias("x"))


def interest_metadata(spark, sf):
    return interest.interest_metadata(_weights(spark, sf), space.percentiles_long(b.item_profile(spark, sf), COLUMNS))


def interest_state(spark, sf):
    got = _weights(spark, sf).groupBy("user_id").pivot("scope", list(interest.SCOPES)).agg(F.round(F.sum("w"), 5))
    return got


def recent_history(spark, sf):
    return interest.recent_history(b.interactions(spark, sf), 10)


def exclude_history(spark, sf):
    """Counts among the 100 items that the query's SQL names."""
    return interest.unseen_counts(b.interactions(spark, sf), b.vectors(spark, sf).filter("item_id < 100"), 10)


def exclude_history_all(spark, sf):
    return interest.unseen_counts(b.interactions(spark, sf), b.vectors(spark, sf), 10)


def _pool(spark, sf) -> DataFrame:
    v = b.vectors(spark, sf)
    q = interest.interest_blend(interest.interest_vectors(_weights(spark, sf), v)).withColumnRenamed("user_id", "query_id")
    got = space.vector_topk(v, q.withColumn("query_id", -F.col("query_id") - 1), 200)
    pool = got.select((-F.col("query_id") - 1).alias("user_id"), "item_id", "similarity")
    percentiles = _space(spark, sf)
    targets = interest.metadata_blend(interest.interest_metadata(_weights(spark, sf), percentiles.unpivot("item_id", COLUMNS, "col", "p").filter("p is not null")))
    return interest.feed_terms(pool, targets, percentiles, COLUMNS)


def feed_terms(spark, sf):
    """What each user's 200 nearest items are worth before novelty and diversity."""
    return _pool(spark, sf).select("user_id", "item_id", F.round("by_vector", 6).alias("by_vector"), F.round(F.col("similarity") + 1e-9, 4).alias("similarity"), F.round(F.col("preference") + 1e-9, 4).alias("preference"))


def feed_mmr(spark, sf):
    history = interest.recent_history(b.interactions(spark, sf), 10)
    return interest.feed(_pool(spark, sf).drop("by_vector"), history, b.vectors(spark, sf), 20)


def cold_start(spark, sf):
    return interest.cold_start(b.vectors(spark, sf), 10)


def popularity(spark, sf):
    return store.popularity(b.interactions(spark, sf)).withColumn("popularity", F.round("popularity", 6))


def _frames(spark, sf) -> DataFrame:
    return b.table(spark, sf, "events").select("event_type", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1e6).alias("t"), F.col("value").alias("v"))


def time_grid(spark, sf):
    """Hourly means and rates per event type."""
    return series.grid(_frames(spark, sf), 3600.0, ["event_type"]).select("event_type", "bucket", "time", F.round("mean", 6).alias("mean"), "n", F.round(F.col("n") / 3600.0, 9).alias("rate"))


GRID_CTE = "g0 AS (SELECT event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 / 3600.0) AS INTEGER) AS bucket, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2), sp AS (SELECT event_type, unnest(range(max(bucket) + 1)) AS bucket FROM g0 GROUP BY 1), g AS (SELECT sp.event_type, CAST(sp.bucket AS INTEGER) AS bucket, mean, coalesce(n, 0) AS n FROM sp LEFT JOIN g0 ON sp.event_type = g0.event_type AND sp.bucket = g0.bucket)"


def _daily(spark, sf) -> DataFrame:
    return b.curves(spark, sf).select("user_id", F.posexplode("curve").alias("day", "v"))


DAILY_CTE = f"d AS (SELECT user_id, CAST(unnest(range(30)) AS INTEGER) AS day, unnest(curve) AS v FROM ({b.CURVE_SQL}))"


def gap_fill(spark, sf):
    return series.fill_gaps(series.grid(_frames(spark, sf), 3600.0, ["event_type"]), ["event_type"], "bucket", "mean").select("event_type", "bucket", F.round("filled", 6).alias("filled"))


def moving_average(spark, sf):
    return _daily(spark, sf).select("user_id", "day", F.round(series.edge_window(["user_id"], "day", "v", 5, series.mean_of), 6).alias("smooth"))


def median_filter(spark, sf):
    return _daily(spark, sf).select("user_id", "day", F.round(series.edge_window(["user_id"], "day", "v", 5, series.median_of), 6).alias("smooth"))


_EDGE = "[" + ", ".join(f"v[least(30, greatest(1, i + {o}))]" for o in (-2, -1, 0, 1, 2)) + "]"
EDGE_SQL = f"WITH {DAILY_CTE}, a AS (SELECT user_id, list(v ORDER BY day) AS v FROM d GROUP BY 1) SELECT user_id, CAST(i - 1 AS INTEGER) AS day, round(list_%s({_EDGE}), 6) AS smooth FROM a, unnest(range(1, 31)) AS q(i)"


def minmax_curve(spark, sf):
    return _daily(spark, sf).select("user_id", "day", F.round(series.min_max("v", ["user_id"]), 6).alias("scaled"))


def rank_percent(spark, sf):
    return b.table(spark, sf, "customer").select("c_custkey", F.round(series.rank_percent("c_acctbal", "c_custkey", ["c_nationkey"]), 6).alias("p"))


def run_collapse(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("at"))
    got = series.runs(e.withColumn("at", F.struct("at", "event_id")), ["user_id"], "at", "event_type")
    return got.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"))


def interval_histogram(spark, sf):
    from pyspark.sql import Window

    step = F.abs(F.lag(F.round(F.col("v") * 10)).over(Window.partitionBy("user_id").orderBy("day")) - F.round(F.col("v") * 10)).cast("int")
    return _daily(spark, sf).select("user_id", step.alias("step")).filter("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def tempo_stats(spark, sf):
    """Regularity of each user's events: 1 - deviation / mean of the gaps, rate, and their blend."""
    from pyspark.sql import Window

    t = b.interactions(spark, sf)
    gap = F.col("epoch_s") - F.lag("epoch_s").over(Window.partitionBy("user_id").orderBy("epoch_s", "event_id"))
    got = t.select("user_id", "epoch_s", gap.alias("gap")).groupBy("user_id").agg(space.clip(1 - F.stddev_pop("gap") / (F.avg("gap") + 1e-9)).alias("c"), (F.count(F.lit(1)) / ((F.max("epoch_s") - F.min("epoch_s")) / 3600 + 1e-9)).alias("d"))
    return got.select("user_id", F.round("c", 6).alias("consistency"), F.round("d", 6).alias("density"), F.round(0.6 * F.col("c") + 0.4 * F.least(F.col("d") / 10, F.lit(1.0)), 6).alias("blend"))


def high_intervals(spark, sf):
    return series.high_runs(_daily(spark, sf), ["user_id"], "day", "v")


def densest_window(spark, sf):
    return series.densest_window(_daily(spark, sf), ["user_id"], "day", "v", 7)


def sliding_windows(spark, sf):
    w = F.window("ts", "8 hours", "4 hours")
    got = b.table(spark, sf, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return got.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "n", "mean")


def sessions(spark, sf):
    """Runs of events of a user without a gap of a day."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("epoch_s", "event_id")
    t = b.interactions(spark, sf).withColumn("new", F.when(F.col("epoch_s") - F.lag("epoch_s").over(w) <= 86400, 0).otherwise(1))
    t = t.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("epoch_s") - F.min("epoch_s"), 3).alias("seconds"))


SEGMENTS = [(0.0, 7.0), (7.0, 12.0), (12.0, 13.0), (13.0, 25.0), (25.0, 30.0)]


def segment_means(spark, sf):
    seg = spark.createDataFrame(SEGMENTS, "seg_start double, seg_end double")
    return series.segment_means(_daily(spark, sf).withColumnRenamed("day", "t"), seg, ["user_id"]).withColumn("mean", F.round(F.col("mean") + 1e-9, 6))


def peaks_prominence(spark, sf):
    return series.peaks(_daily(spark, sf), ["user_id"], "day", "v", 0.3, 3)


def library_fingerprint(spark, sf):
    return store.fingerprint(b.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), "o_orderkey", "o_orderdate")


def storage_profile(spark, sf):
    return store.storage(b.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


def _versions(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.filter("o_orderkey % 10 < 9"), o.filter("o_orderkey % 10 >= 8").withColumn("o_totalprice", F.col("o_totalprice") + 1)


def upsert_items(spark, sf):
    old, new = _versions(spark, sf)
    return store.upsert(old, new, ["o_orderkey"])


def conditional_update(spark, sf):
    old, new = _versions(spark, sf)
    return store.update_if_changed(old, new, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], F.lit("now"))


def incremental_scan(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), F.col("o_totalprice").alias("mtime"), F.col("o_orderkey").alias("k"))
    state = o.filter("k % 4 <> 0").select("path", "size", F.when(F.col("k") % 4 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("k") % 3 == 0, "4").otherwise("5").alias("analysis_version"))
    return scan_status(o.drop("k"), state, "5").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("todo").alias("todo"))


def windowed_delete(spark, sf):
    return store.delete_window(b.interactions(spark, sf), 7, NOW, 604_800.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def stale_flag(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", store.is_stale(F.col("o_orderstatus"), "F").alias("stale"))


TERMS = ["the", "then", "there", "that", "and", "de la", "ist", "que"]


def text_lexicon_match(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(ft.matches_column(F.lower("text"), ["password", "contact", "license", "the password"])).alias("matched"))


def text_negation(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", ft.negated_column(F.lower("text"), "that", ("and", "the")).alias("negated"))


QUERIES = {f.__name__: f for f in (decay_weight, scope_weights, interest_vector, interest_blend, interest_metadata, interest_state, recent_history, exclude_history, exclude_history_all, feed_terms, feed_mmr, cold_start, popularity, time_grid, gap_fill, moving_average, median_filter, minmax_curve, rank_percent, run_collapse, interval_histogram, tempo_stats, high_intervals, densest_window, sliding_windows, sessions, segment_means, peaks_prominence, library_fingerprint, storage_profile, upsert_items, conditional_update, incremental_scan, windowed_delete, stale_flag, text_lexicon_match, text_negation)}
_HIST = "SELECT user_id, item_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_s DESC, event_id DESC) AS place FROM log WHERE event IN ('play', 'complete', 'replay', 'like')) WHERE place <= 10"
_TARGET_COLS = ", ".join(f"max(CASE WHEN col = '{c}' THEN target END) AS t_{c}" for c in COLUMNS)
_AFFINITY = "list_avg(list_filter([" + ", ".join(f"1 - abs({c} - t_{c})" for c in COLUMNS) + "], lambda v: v IS NOT NULL))"
FEED_TERMS_SQL = (
    SCOPE_CTE.replace("WITH ", SPACE_SQL + ", ", 1) + VECTOR_CTE[len(SCOPE_CTE) :]
    + ", bl AS (SELECT user_id, pos, sum(x * CASE scope " + " ".join(f"WHEN '{s}' THEN {lam}" for s, (_, lam) in interest.SCOPES.items()) + " END) AS x FROM vu GROUP BY 1, 2)"
    + ", q AS (SELECT user_id, list(x ORDER BY pos) AS v, sqrt(sum(x * x)) AS n FROM bl GROUP BY 1)"
    + ", ip AS (SELECT user_id, vec_id AS item_id, round(least(1.0, greatest(0.0, (list_inner_product(v, CAST(embedding AS DOUBLE[])) / n + 1) / 2)), 6) AS sim FROM q, embeddings)"
    + ", pool AS (SELECT user_id, item_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS r FROM ip) WHERE r <= 200)"
    + ", base AS (SELECT * FROM sw WHERE item_id IN (SELECT item_id FROM long)), tot AS (SELECT user_id, scope, sum(abs(w)) AS total FROM base GROUP BY 1, 2)"
    + ", ws AS (SELECT user_id, scope, col, sum(w * p) AS s FROM base JOIN long USING (item_id) GROUP BY 1, 2, 3)"
    + ", ms AS (SELECT t.user_id, t.scope, c.col, round(coalesce(s, 0.0) / total + 1e-9, 3) AS target FROM tot t CROSS JOIN (SELECT DISTINCT col FROM long) c LEFT JOIN ws ON ws.user_id = t.user_id AND ws.scope = t.scope AND ws.col = c.col WHERE total > 0)"
    + ", mb AS (SELECT user_id, col, sum(target * CASE scope " + " ".join(f"WHEN '{s}' THEN {lam}" for s, (_, lam) in interest.SCOPES.items()) + " END) AS target FROM ms GROUP BY 1, 2)"
    + f", mw AS (SELECT user_id, {_TARGET_COLS} FROM mb GROUP BY 1), k AS (SELECT pool.user_id, pool.item_id, sim, {_AFFINITY} AS meta FROM pool LEFT JOIN space ON space.item_id = pool.item_id LEFT JOIN mw ON mw.user_id = pool.user_id)"
    + " SELECT user_id, item_id, sim AS by_vector, round(coalesce(meta, sim) + 1e-9, 4) AS similarity, round(coalesce(0.6 * sim + 0.4 * meta, sim) + 1e-9, 4) AS preference FROM k"
)
ORACLE_SQL = {
    "feed_terms": FEED_TERMS_SQL,
    "decay_weight": f"WITH {LOG} SELECT event_id, round({WEIGHT_SQL}, 6) AS w FROM log",
    "scope_weights": SCOPE_CTE + " SELECT user_id, scope, item_id, round(w, 6) AS w FROM sw",
    "interest_vector": VECTOR_CTE + " SELECT user_id, scope, pos, round(x, 6) AS x FROM vu",
    "interest_blend": VECTOR_CTE + ", bl AS (SELECT user_id, pos, sum(x * CASE scope " + " ".join(f"WHEN '{s}' THEN {lam}" for s, (_, lam) in interest.SCOPES.items()) + " END) AS x FROM vu GROUP BY 1, 2) SELECT user_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 5) AS x FROM bl",
    "interest_metadata": SCOPE_CTE + f", items AS ({b.ITEM_SQL}), long AS {LONG_SQL}, base AS (SELECT * FROM sw WHERE item_id IN (SELECT item_id FROM long)), t AS (SELECT user_id, scope, sum(abs(w)) AS total FROM base GROUP BY 1, 2), s AS (SELECT user_id, scope, col, sum(w * p) AS s FROM base JOIN long USING (item_id) GROUP BY 1, 2, 3) SELECT t.user_id, t.scope, c.col, round(coalesce(s, 0.0) / total + 1e-9, 3) AS target FROM t CROSS JOIN (SELECT DISTINCT col FROM long) c LEFT JOIN s ON s.user_id = t.user_id AND s.scope = t.scope AND s.col = c.col WHERE total > 0",
    "interest_state": SCOPE_CTE + " SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN scope = '{s}' THEN w END), 5) AS {s}" for s in interest.SCOPES) + " FROM sw GROUP BY 1",
    "recent_history": f"WITH {LOG} {_HIST}",
    "exclude_history": f"WITH {LOG}, h AS ({_HIST}) SELECT u.user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM log) u CROSS JOIN (SELECT vec_id FROM embeddings WHERE vec_id < 100) v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = u.user_id AND h.item_id = v.vec_id) GROUP BY 1",
    "exclude_history_all": f"WITH {LOG}, h AS ({_HIST}) SELECT u.user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM log) u CROSS JOIN embeddings v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = u.user_id AND h.item_id = v.vec_id) GROUP BY 1",
    "popularity": f"WITH {LOG}, k AS (SELECT user_id, item_id, count(*) FILTER (WHERE event IN ('like', 'complete', 'replay')) AS k FROM log GROUP BY 1, 2) SELECT user_id, item_id, round(coalesce(k / CAST(nullif(max(k) OVER (PARTITION BY user_id), 0) AS DOUBLE), 0.0), 6) AS popularity FROM k",
    "time_grid": f"WITH {GRID_CTE} SELECT event_type, bucket, (bucket + 0.5) * CAST(3600 AS DOUBLE) AS time, round(mean, 6) AS mean, n, round(n / CAST(3600 AS DOUBLE), 9) AS rate FROM g",
    "gap_fill": f"WITH {GRID_CTE}, n AS (SELECT *, last_value(mean IGNORE NULLS) OVER b AS p, last_value(CASE WHEN mean IS NOT NULL THEN bucket END IGNORE NULLS) OVER b AS pt, first_value(mean IGNORE NULLS) OVER a AS nx, first_value(CASE WHEN mean IS NOT NULL THEN bucket END IGNORE NULLS) OVER a AS nt FROM g WINDOW b AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_type, bucket, round(coalesce(mean, CASE WHEN p IS NULL THEN nx WHEN nx IS NULL THEN p ELSE p + (nx - p) * (bucket - pt) / (nt - pt) END), 6) AS filled FROM n",
    "moving_average": EDGE_SQL % "avg",
    "median_filter": EDGE_SQL % "median",
    "minmax_curve": f"WITH {DAILY_CTE} SELECT user_id, day, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0.5), 6) AS scaled FROM d WINDOW w AS (PARTITION BY user_id)",
    "rank_percent": "SELECT c_custkey, round((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / CAST(greatest(count(*) OVER (PARTITION BY c_nationkey) - 1, 1) AS DOUBLE), 6) AS p FROM customer",
    "run_collapse": "SELECT user_id, run, event_type, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2, 3",
    "interval_histogram": f"WITH {DAILY_CTE}, s AS (SELECT CAST(abs(lag(round(v * 10)) OVER (PARTITION BY user_id ORDER BY day) - round(v * 10)) AS INTEGER) AS step FROM d) SELECT step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1",
    "tempo_stats": f"WITH {LOG}, g AS (SELECT user_id, epoch_s, epoch_s - lag(epoch_s) OVER (PARTITION BY user_id ORDER BY epoch_s, event_id) AS gap FROM log), a AS (SELECT user_id, least(1.0, greatest(0.0, 1 - stddev_pop(gap) / (avg(gap) + 1e-9))) AS c, count(*) / ((max(epoch_s) - min(epoch_s)) / 3600 + 1e-9) AS d FROM g GROUP BY 1) SELECT user_id, round(c, 6) AS consistency, round(d, 6) AS density, round(0.6 * c + 0.4 * least(d / 10, 1.0), 6) AS blend FROM a",
    "high_intervals": f"WITH {DAILY_CTE}, l AS (SELECT user_id, median(v) + 0.5 * (max(v) - min(v)) AS lim FROM d GROUP BY 1), h AS (SELECT d.*, v > lim AS high FROM d JOIN l USING (user_id)), n AS (SELECT *, CASE WHEN high = lag(high) OVER (PARTITION BY user_id ORDER BY day) THEN 0 ELSE 1 END AS new FROM h), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM n) SELECT user_id, min(day) AS start, max(day) AS \"end\", count(*) AS n FROM r WHERE high GROUP BY user_id, run HAVING count(*) >= 2",
    "densest_window": f"WITH {DAILY_CTE}, s AS (SELECT user_id, day AS start, round(sum(v) OVER w, 6) AS total, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT user_id, start, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, start) AS r FROM s WHERE n = 7) WHERE r = 1",
    "sliding_windows": "SELECT CAST(start AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([CAST(floor(epoch_us(ts) / 14400000000.0) AS BIGINT) * 14400, CAST(floor(epoch_us(ts) / 14400000000.0) AS BIGINT) * 14400 - 14400]) AS start FROM events) GROUP BY 1",
    "sessions": f"WITH {LOG}, n AS (SELECT *, CASE WHEN epoch_s - lag(epoch_s) OVER (PARTITION BY user_id ORDER BY epoch_s, event_id) <= 86400 THEN 0 ELSE 1 END AS new FROM log), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY epoch_s, event_id) AS BIGINT) AS session FROM n) SELECT user_id, session, count(*) AS n, round(max(epoch_s) - min(epoch_s), 3) AS seconds FROM s GROUP BY 1, 2",
    "segment_means": f"WITH {DAILY_CTE}, g(seg_start, seg_end) AS (VALUES " + ", ".join(f"(CAST({s} AS DOUBLE), CAST({e} AS DOUBLE))" for s, e in SEGMENTS) + ") SELECT user_id, seg_start, seg_end, round(avg(v) + 1e-9, 6) AS mean FROM d JOIN g ON day >= seg_start AND day < seg_end GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "library_fingerprint": "SELECT count(*) AS n, max(CAST(o_orderdate AS DATE)) AS max_o_orderdate, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders",
    "storage_profile": " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(sum(strlen(CAST({c} AS VARCHAR))) AS BIGINT) AS bytes FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")),
    "upsert_items": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 >= 8 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders",
    "conditional_update": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 8 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 10 = 8 THEN 'now' END AS updated_at FROM orders WHERE o_orderkey % 10 < 9",
    "incremental_scan": "SELECT status, count(*) AS n, count(*) FILTER (WHERE status <> 'same') AS todo FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 4 = 1 THEN 'changed' WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE 'same' END AS status FROM orders) GROUP BY 1",
    "windowed_delete": f"WITH {LOG} SELECT user_id, count(*) AS n FROM log WHERE NOT (user_id = 7 AND epoch_s >= {NOW - 604800.0}) GROUP BY 1",
    "stale_flag": "SELECT o_orderkey, o_orderstatus <> 'F' AS stale FROM orders",
    "text_negation": "SELECT doc_id, p > 1 AND regexp_matches(substr(t, CAST(greatest(1, p - 4) AS BIGINT), CAST(greatest(0, least(4, p - 1)) AS BIGINT)), 'and|the') AS negated FROM (SELECT doc_id, lower(text) AS t, instr(lower(text), 'that') AS p FROM documents)",
}
