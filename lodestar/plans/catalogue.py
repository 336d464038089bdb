"""Lookups, overlays, tags, reports, exports and structure terms on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import sequences as fs
from lodestar.operators import catalogue as c
from lodestar.operators import interest, series, space, store, structure
from lodestar.plans.activity import DAILY_CTE, LOG, NOW, _daily
from lodestar.plans.retrieval import COLUMNS, DURATION_SQL, LONG_SQL, PEARSON_SQL, SEQ_SQL, SPACE_SQL, TARGETS, TOPK_SQL, _space, null_mean_sql
from lodestar.sources import bindings as b
from lodestar.sources.files import select_existing


def point_lookup(spark, sf):
    return c.point_lookup(b.table(spark, sf, "part"), p_partkey=17).select("p_partkey", "p_name")


def vector_lengths(spark, sf):
    return c.vector_lengths(b.vectors(spark, sf))


def display_list(spark, sf):
    ids = spark.createDataFrame(list(enumerate([5, 3, 5, 99_999_999, 1, 3])), "place int, item_id bigint")
    return c.display_list(ids, b.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")))


def columns_of(spark, sf):
    return c.columns_of(b.table(spark, sf, "orders"))


def projected_scan(spark, sf):
    return select_existing(b.table(spark, sf, "customer"), ["c_custkey", "no_such_column", "c_mktsegment"])


def preset_overlay(spark, sf):
    n = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    extra = n.filter("id % 5 = 0").unionByName(n.filter("id = 1").withColumn("id", F.col("id") + 100)).withColumn("name", F.lower("name"))
    return c.overlay(n, extra)


def category_listing(spark, sf):
    presets = b.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    found = b.table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return c.listing(preset=presets, discovered=found)


def unscored_dims(spark, sf):
    """Targets on rows without the flag, whose tax columns are null."""
    return c.unscored(_space(spark, sf).filter("flagged = 0"), TARGETS)


def interaction_range(spark, sf):
    return c.interaction_range(b.interactions(spark, sf), 7, NOW - 604_800, 20).select("event_id", "item_id", "event")


def analysis_scope(spark, sf):
    version = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("string"))
    return b.table(spark, sf, "orders").groupBy(c.analysis_scope(version).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def completed_rows(spark, sf):
    return c.completed(b.item_profile(spark, sf), ["tax_mean", "n_lines"]).select("item_id")


def feed_excludes(spark, sf):
    log = b.interactions(spark, sf)
    given = log.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, (1, 2, 3))).cast("array<bigint>")).alias("item_id"))
    return c.exclusions(given, interest.recent_history(log, 10))


def frame_statistics(spark, sf):
    got = c.frame_statistics(b.table(spark, sf, "events"), ["user_id"], "value")
    return got.select("user_id", *(F.round(F.col(x) + 1e-9, 5).alias(x) for x in got.columns[1:]))


_FRAME_COLS = {"mean": "avg(value)", "std": "stddev_pop(value)"} | {f"p{int(p * 100)}": f"quantile_cont(value, {p})" for p in (0.1, 0.25, 0.5, 0.75, 0.9)} | {"top": "max(value)", "dynamic_range": "quantile_cont(value, 0.95) - quantile_cont(value, 0.1)", "crest": "max(value) / (avg(value) + 1e-9)"}


def group_sizes(spark, sf):
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("brand"))
    return b.item_profile(spark, sf).select("item_id", "brand", n.alias("members"), (n > 1).alias("repeated"))


def _customers(spark, sf):
    tag = F.when(F.col("c_custkey") % 4 != 0, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("COMMON"))
    return b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), tag.alias("segment"), F.concat(F.lit(" n"), F.col("c_nationkey").cast("string")).alias("nation"), (F.col("c_acctbal") > 4000).cast("int").alias("rich"))


def tag_evidence(spark, sf):
    got = c.tag_evidence(_customers(spark, sf), ["segment", "nation"])
    return got.select("cluster", "field", "value", F.round("coverage", 3).alias("coverage"), F.round("purity", 3).alias("purity"))


_CUSTOMERS = "m AS (SELECT c_nationkey AS cluster, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'COMMON' END END AS segment, 'n' || c_nationkey AS nation, CAST(c_acctbal > 4000 AS INTEGER) AS rich FROM customer)"
TAG_SQL = f"""WITH {_CUSTOMERS}, t AS (SELECT cluster, 0 AS o, 'segment' AS field, trim(segment) AS value FROM m UNION ALL SELECT cluster, 1, 'nation', trim(nation) FROM m),
 n AS (SELECT cluster, o, field, value, count(*) AS n FROM t WHERE value <> '' GROUP BY ALL), s AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1),
 p AS (SELECT *, sum(n) OVER (PARTITION BY cluster, o) AS tagged, row_number() OVER (PARTITION BY cluster, o ORDER BY n DESC, value) AS r FROM n),
 g AS (SELECT cluster, o, field, value, tagged / size AS coverage, n / tagged AS purity FROM p JOIN s USING (cluster) WHERE r = 1)
 SELECT cluster, field, value, round(CAST(coverage AS DOUBLE), 3) AS coverage, round(CAST(purity AS DOUBLE), 3) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY o) AS f FROM g WHERE coverage >= 0.6 AND purity >= 0.7) WHERE f = 1"""


def cluster_presence(spark, sf):
    return c.presence(_customers(spark, sf), "rich").select("cluster", F.round("share", 3).alias("share"), "filter")


def cluster_targets(spark, sf):
    items = b.item_profile(spark, sf)
    return c.cluster_targets(space.percentiles_long(items, COLUMNS), items.select("item_id", F.col("brand").alias("cluster")), least=0.02)


def tempo_runs(spark, sf):
    got = c.tempo_runs(_daily(spark, sf).filter("v > 0"), ["user_id"], "day", "v")
    return got.select("user_id", "start", "end", F.round(F.col("mean") + 1e-9, 5).alias("mean"), "n")


def tempo_stability(spark, sf):
    got = c.tempo_stability(_daily(spark, sf).filter("v > 0"), ["user_id"], "v")
    return got.select("user_id", *(F.round(F.col(x) + 1e-9, 5).alias(x) for x in ("median", "half", "double")), "stable")


_POS = f"{DAILY_CTE}, p AS (SELECT * FROM d WHERE v > 0), l AS (SELECT user_id, median(v) AS m, count(*) AS c FROM p GROUP BY 1)"
TEMPO_SQL = f"""WITH {_POS}, a AS (SELECT p.*, abs(v - m) > 0.1 * m AS away FROM p JOIN l USING (user_id) WHERE m > 0 AND c >= 3), n AS (SELECT *, CASE WHEN away = lag(away) OVER (PARTITION BY user_id ORDER BY day) THEN 0 ELSE 1 END AS new FROM a),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM n) SELECT user_id, min(day) AS start, max(day) AS "end", round(avg(v) + 1e-9, 5) AS mean, count(*) AS n FROM r WHERE away GROUP BY user_id, run HAVING count(*) >= 2"""


def run_peaks(spark, sf):
    """Runs of equal event types with their greatest value."""
    e = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return series.runs(e, ["user_id"], "at", "event_type").groupBy("user_id", "run", "event_type").agg(F.round(F.max("value"), 6).alias("top"))


def interval_steps(spark, sf):
    """Steps between a user's rounded values, those of more than 24 left out."""
    from pyspark.sql import Window

    value = F.round("value").cast("int")
    step = value - F.lag(value).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return b.table(spark, sf, "events").select("user_id", step.alias("step")).filter(F.abs("step") <= 24).groupBy("user_id", F.abs("step").alias("step")).agg(F.count(F.lit(1)).alias("n"))


def series_levels(spark, sf):
    p = F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.95, 0.98))))
    got = _daily(spark, sf).groupBy("user_id").agg(p.alias("p"))
    return got.select("user_id", *(F.round(F.col("p")[i] + 1e-9, 5).alias(n) for i, n in enumerate(("p25", "p50", "p95", "p98"))))


def read_tags(spark, sf):
    o = b.table(spark, sf, "orders")
    even, third = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    got = c.tags(o, F.when(even, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))), [F.when(third, F.lit("  ")).otherwise(F.when(even, F.col("o_orderstatus"))), F.when(third, F.lit("album artist"))], F.when(even, F.concat(F.lit("on "), F.col("o_orderdate").cast("date").cast("string"))))
    return got.select("o_orderkey", "title", "artist", "year", "meta_source")


READ_TAGS_SQL = """SELECT o_orderkey, title, artist, year, CASE WHEN title IS NULL AND artist IS NULL AND year IS NULL THEN 'none' ELSE 'tag' END AS meta_source FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN trim(o_orderpriority) END AS title,
 CASE WHEN o_orderkey % 3 = 0 THEN 'album artist' WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS artist, CASE WHEN o_orderkey % 2 = 0 THEN CAST(nullif(regexp_extract('on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '(1[0-9]{3}|20[0-9]{2}|30[0-9]{2})', 1), '') AS INTEGER) END AS year FROM orders)"""


def file_labels(spark, sf):
    p = b.table(spark, sf, "pages")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), F.col("page_id").cast("string")))
    return p.select("page_id", c.file_name(F.col("url")).alias("file_name"), c.label(F.when(F.col("page_id") % 3 == 0, F.lit("a")), title, F.col("url")).alias("label"))


def parsed_sequences(spark, sf):
    t = b.token_sequences(spark, sf).withColumn("tokens", F.slice("tokens", 1, 20))
    raw = F.when(F.col("user_id") % 2 == 0, F.to_json("tokens")).otherwise(F.concat(F.array_join("tokens", ", "), F.lit(",,")))
    return t.select("user_id", F.array_join(fs.parse_sequence(raw), "|").alias("tokens"))


def upsert_embeddings(spark, sf):
    v = b.table(spark, sf, "embeddings").select("vec_id", "label")
    return store.upsert(v.filter("vec_id % 10 < 9"), v.filter("vec_id % 10 >= 8").withColumn("label", F.col("label") + 1), ["vec_id"])


def tag_backfill(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title"))
    items = o.withColumn("meta_source", F.when(F.col("title").isNotNull(), "tag").otherwise("none"))
    found = o.select("o_orderkey", F.lit("found").alias("title"), F.lit("tag").alias("meta_source"))
    return c.backfill(items, o.filter("o_orderkey % 3 = 0"), found, "o_orderkey", ["title", "meta_source"], F.lit("now"))


def label_loop(spark, sf):
    """Judgements that are added to those there are, and what they say then."""
    old = b.table(spark, sf, "labels").select("doc_id", "quality")
    return store.evaluation_stats(old.unionByName(old.filter("doc_id % 3 = 0").withColumn("quality", F.lit(1).cast(old.schema["quality"].dataType))), "quality")


def labels_csv(spark, sf):
    rows = b.table(spark, sf, "labels").select(F.col("doc_id").alias("seed"), (F.col("doc_id") + 1).alias("recommendation"), F.col("quality").cast("int").alias("label"))
    c.export_labels(rows, path := c.scratch(spark, "labels-csv"))
    return spark.read.option("header", True).schema("seed bigint, recommendation bigint, label int").csv(path)


def payload_tsv(spark, sf):
    t = b.token_sequences(spark, sf).withColumn("tokens", F.slice("tokens", 1, 8)).withColumn("none", F.lit(None).cast("double"))
    c.export_payload(t, ["user_id", "none", "tokens"], path := c.scratch(spark, "payload-tsv"))
    return spark.read.text(path).select(F.replace(F.replace("value", F.lit("\t"), F.lit("<tab>")), F.lit(c.UNIT), F.lit("|")).alias("line"))


def index_reload(spark, sf):
    v = b.vectors(spark, sf)
    c.VectorIndex.build(v).save(path := c.scratch(spark, "vector-index"))
    return c.VectorIndex.load(spark, path).search(v.filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vector"), 5)


CONDITIONS = {"flagged": True, "p_size_min": 5, "absent_min": 3, "type_is": "ECONOMY TIN", "odd": 1}


def category_report(spark, sf):
    return c.category_report(b.item_profile(spark, sf), _space(spark, sf), TARGETS | {"no_such_dim": 0.5}, CONDITIONS, {"type_is": "type", "brand_is": "brand"})


def refused_report(spark, sf):
    """A request that names nothing the library has."""
    return c.category_report(b.item_profile(spark, sf), _space(spark, sf), {"no_such_dim": 0.5}, {}, {})


_NEAR = null_mean_sql([f"abs(space.{k} - {t})" for k, t in TARGETS.items()])
REPORT_SQL = SPACE_SQL + f""", n AS (SELECT count(*) AS pool, count(*) FILTER (WHERE type IS NULL OR type = '') AS bare FROM items), s AS (SELECT count(*) AS support FROM items JOIN space USING (item_id) WHERE items.flagged = 1 AND p_size >= 5 AND lower(trim(type)) = 'economy tin' AND {_NEAR} <= 0.25)
 SELECT '{",".join(TARGETS)}' AS usable, 'no_such_dim' AS ignored, 'absent_min,odd' AS unknown_filters, 'flagged' AS filter_estimated, 'type:' || bare AS tag_missing, pool, support, greatest(5, CAST(round_even(pool * 0.05, 0) AS BIGINT)) AS min_support, support < greatest(5, CAST(round_even(pool * 0.05, 0) AS BIGINT)) AS low_support, false AS refused FROM n, s""".replace("p_size >= 5", "items.p_size >= 5")
REFUSED_SQL = "SELECT '' AS usable, 'no_such_dim' AS ignored, '' AS unknown_filters, '' AS filter_estimated, '' AS tag_missing, count(*) AS pool, CAST(0 AS BIGINT) AS support, greatest(5, CAST(round_even(count(*) * 0.05, 0) AS BIGINT)) AS min_support, true AS low_support, true AS refused FROM part"


def _neighbours(spark, sf):
    t = b.token_sequences(spark, sf).withColumn("tokens", fs.cap_sequence(F.col("tokens"))).join(b.curves(spark, sf), "user_id")
    left = t.select(F.col("user_id").alias("u1"), F.col("tokens").alias("x"), F.col("curve").alias("cx"))
    return left.join(t.select((F.col("user_id") - 1).alias("u1"), F.col("tokens").alias("y"), F.col("curve").alias("cy")), "u1")


def structure_similarity(spark, sf):
    """Curves, token order and duration profiles of users next to each other in id."""
    pos = lambda v: F.filter(v, lambda x: x > 0)
    got = space.structure_similarity((F.col("cx"), F.col("cy")), (F.col("x"), F.col("y")), (pos("cx"), pos("cy")))
    return _neighbours(spark, sf).select("u1", F.round(got + 1e-9, 4).alias("similarity"))


def group_similarity(spark, sf):
    """A scalar similarity (of the days a user was active) and the order of tokens, half each."""
    active = lambda v: F.size(F.filter(v, lambda x: x > 0)) / 30.0
    scalar = 1 - F.abs(active("cx") - active("cy"))
    return _neighbours(spark, sf).select("u1", F.round(space.with_sequences(scalar, F.col("x"), F.col("y")) + 1e-9, 4).alias("similarity"))


def _sections(spark, sf):
    """Five-day sections of users' curves, grouped by the greater half of their values."""
    pos = F.expr("day div 5").cast("int").alias("pos")
    got = _daily(spark, sf).groupBy("user_id", pos).agg(F.round(F.avg("v"), 6).alias("energy"), F.count_if(F.col("v") > 0.3).cast("double").alias("onset"))
    return got.withColumn("group", F.when(F.col("energy") >= 0.45, "A").when(F.col("energy") >= 0.25, "B").otherwise("C"))


def section_labels(spark, sf):
    return structure.label_sections(_sections(spark, sf), ["user_id"]).select("user_id", "pos", "group", "part", "confidence")


def chorus_summary(spark, sf):
    return structure.chorus_summary(structure.label_sections(_sections(spark, sf), ["user_id"]), ["user_id"])


#: The parts' SQL without their rounding.
_SEQ = SEQ_SQL.replace("round(0.35 * lev + 0.45 * gram + 0.2 * jac, 6)", "(0.35 * lev + 0.45 * gram + 0.2 * jac)")
_PEARSON = PEARSON_SQL.replace("round(least(1.0, greatest(0.0, (corr(x, y) + 1) / 2)), 6)", "least(1.0, greatest(0.0, (corr(x, y) + 1) / 2))")
_DURATION = DURATION_SQL.replace("round((cum[low + 1]", "((cum[low + 1]").replace("/ cum[len(cum)], 6) AS share", "/ cum[len(cum)]) AS share")
_STRUCTURE_CTES = f"""seq AS ({_SEQ}), pe AS ({_PEARSON}), du AS ({_DURATION}), dp AS (SELECT a.user_id AS u1, least(1.0, greatest(0.0, (corr(a.share, d.share) + 1) / 2)) AS s, stddev_pop(a.share) AS sa, stddev_pop(d.share) AS sb FROM du a JOIN du d ON d.user_id = a.user_id + 1 AND d.pos = a.pos GROUP BY 1)"""
STRUCTURE_SQL = f"""WITH {_STRUCTURE_CTES}, k AS (SELECT seq.u1, CASE WHEN isfinite(pe.similarity) THEN pe.similarity END AS e, combined AS g, CASE WHEN sa > 1e-6 AND sb > 1e-6 THEN dp.s END AS p FROM seq JOIN pe ON pe.u1 = seq.u1 LEFT JOIN dp ON dp.u1 = seq.u1)
 SELECT u1, round((coalesce(0.45 * e, 0) + 0.3 * g + coalesce(0.25 * p, 0)) / (CASE WHEN e IS NULL THEN 0 ELSE 0.45 END + 0.3 + CASE WHEN p IS NULL THEN 0 ELSE 0.25 END) + 1e-9, 4) AS similarity FROM k"""
GROUP_SQL = f"""WITH seq AS ({_SEQ}), {DAILY_CTE}, n AS (SELECT user_id, count(*) FILTER (WHERE v > 0) / 30.0 AS a FROM d GROUP BY 1)
 SELECT u1, round(least(1.0, greatest(0.0, 0.5 * (1 - abs(x.a - y.a)) + 0.5 * combined)) + 1e-9, 4) AS similarity FROM seq JOIN n x ON x.user_id = u1 JOIN n y ON y.user_id = u1 + 1"""

QUERIES = {f.__name__: f for f in (point_lookup, vector_lengths, display_list, columns_of, projected_scan, preset_overlay, category_listing, unscored_dims, interaction_range, analysis_scope, completed_rows, feed_excludes, frame_statistics, group_sizes, tag_evidence, cluster_presence, cluster_targets, tempo_runs, tempo_stability, run_peaks, interval_steps, series_levels, read_tags, file_labels, parsed_sequences, upsert_embeddings, tag_backfill, label_loop, labels_csv, payload_tsv, index_reload, category_report, refused_report, structure_similarity, group_similarity, section_labels, chorus_summary)}
_TOKENS20 = f"SELECT user_id, tokens[1:20] AS tokens FROM ({b.SEQUENCE_SQL})"
ORACLE_SQL = {
    "point_lookup": "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17",
    "vector_lengths": "SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS shortest, CAST(max(len(embedding)) AS INTEGER) AS longest FROM embeddings",
    "display_list": "SELECT CAST(i.place AS INTEGER) AS place, CAST(i.item_id AS BIGINT) AS item_id, p_name AS name FROM (VALUES (0, 5), (1, 3), (3, 99999999), (4, 1)) i(place, item_id) LEFT JOIN part ON p_partkey = i.item_id",
    "columns_of": "SELECT cid AS pos, name AS col FROM pragma_table_info('orders')",
    "projected_scan": "SELECT c_custkey, c_mktsegment FROM customer",
    "preset_overlay": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation UNION ALL SELECT 101, lower(n_name) FROM nation WHERE n_nationkey = 1",
    "category_listing": "SELECT n_name AS name, 'preset' AS source FROM nation UNION ALL SELECT DISTINCT p_brand, 'discovered' FROM part",
    "unscored_dims": SPACE_SQL + " SELECT concat_ws(',', " + ", ".join(f"CASE WHEN count({k}) > 0 THEN '{k}' END" for k in sorted(TARGETS)) + ") AS scored, concat_ws(',', " + ", ".join(f"CASE WHEN count({k}) = 0 THEN '{k}' END" for k in sorted(TARGETS)) + ") AS unscored FROM space WHERE flagged = 0",
    "interaction_range": f"WITH {LOG} SELECT event_id, item_id, event FROM log WHERE user_id = 7 AND epoch_s >= {NOW - 604800} ORDER BY epoch_s DESC, event_id DESC LIMIT 20",
    "analysis_scope": "SELECT CASE WHEN v IS NULL THEN 'unknown' WHEN regexp_matches(v, '^[0-9]+$') THEN 'full_track' ELSE 'window' END AS scope, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) END AS v FROM orders) GROUP BY 1",
    "completed_rows": f"SELECT item_id FROM ({b.ITEM_SQL}) WHERE tax_mean IS NOT NULL AND n_lines IS NOT NULL",
    "feed_excludes": f"WITH {LOG} SELECT DISTINCT user_id, CAST(k AS BIGINT) AS item_id FROM log, unnest([1, 2, 3]) q(k) UNION SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_s DESC, event_id DESC) AS place FROM log WHERE event IN ('play', 'complete', 'replay', 'like')) WHERE place <= 10",
    "frame_statistics": "SELECT user_id, " + ", ".join(f"round({e} + 1e-9, 5) AS {n}" for n, e in _FRAME_COLS.items()) + " FROM events GROUP BY 1",
    "group_sizes": "SELECT p_partkey AS item_id, p_brand AS brand, count(*) OVER (PARTITION BY p_brand) AS members, count(*) OVER (PARTITION BY p_brand) > 1 AS repeated FROM part",
    "tag_evidence": TAG_SQL,
    "cluster_presence": f"WITH {_CUSTOMERS} SELECT cluster, round(avg(rich), 3) AS share, CASE WHEN avg(rich) <= 0.25 THEN 'unflagged' WHEN avg(rich) >= 0.75 THEN 'flagged' ELSE '' END AS filter FROM m GROUP BY 1",
    "cluster_targets": f"WITH items AS ({b.ITEM_SQL}), long AS {LONG_SQL}, m AS (SELECT brand AS cluster, col, round(avg(p) - 0.5, 6) AS dev FROM long JOIN items USING (item_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(dev) DESC, col) AS r, max(CASE WHEN abs(dev) >= 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster) AS clear FROM m) SELECT cluster, col, round(dev + 0.5 + 1e-9, 3) AS target FROM r WHERE CASE WHEN clear = 1 THEN abs(dev) >= 0.02 AND r <= 3 ELSE r <= 2 END",
    "tempo_runs": TEMPO_SQL,
    "tempo_stability": f"WITH {_POS}, a AS (SELECT user_id, m, c, avg(abs(v - m)) AS x FROM p JOIN l USING (user_id) GROUP BY ALL) SELECT user_id, round(m + 1e-9, 5) AS median, round(m / 2 + 1e-9, 5) AS half, round(m * 2 + 1e-9, 5) AS \"double\", c >= 3 AND m > 0 AND x <= 0.05 * m AS stable FROM a",
    "run_peaks": "SELECT user_id, run, event_type, round(max(value), 6) AS top FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2, 3",
    "interval_steps": "SELECT user_id, abs(step) AS step, count(*) AS n FROM (SELECT user_id, CAST(round(value) AS INTEGER) - lag(CAST(round(value) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) WHERE abs(step) <= 24 GROUP BY 1, 2",
    "series_levels": f"WITH {DAILY_CTE} SELECT user_id, " + ", ".join(f"round(quantile_cont(v, {p}) + 1e-9, 5) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p95", 0.95), ("p98", 0.98))) + " FROM d GROUP BY 1",
    "read_tags": READ_TAGS_SQL,
    "file_labels": "SELECT page_id, f AS file_name, CASE WHEN page_id % 2 <> 0 THEN f WHEN page_id % 3 = 0 THEN 'a - t' || page_id ELSE 't' || page_id END AS label FROM (SELECT page_id, coalesce(string_split(url, '/')[-1], '') AS f FROM pages)",
    "parsed_sequences": f"SELECT user_id, array_to_string(tokens, '|') AS tokens FROM ({_TOKENS20})",
    "upsert_embeddings": "SELECT vec_id, CASE WHEN vec_id % 10 >= 8 THEN label + 1 ELSE label END AS label FROM embeddings",
    "tag_backfill": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'found' END AS title, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'tag' ELSE 'none' END AS meta_source, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0 THEN 'now' END AS updated_at FROM orders",
    "label_loop": "SELECT count(*) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS positive, round(sum(quality) / CAST(count(*) AS DOUBLE), 6) AS agreement FROM (SELECT quality FROM labels UNION ALL SELECT 1 FROM labels WHERE doc_id % 3 = 0)",
    "labels_csv": "SELECT doc_id AS seed, doc_id + 1 AS recommendation, CAST(quality AS INTEGER) AS label FROM labels",
    "payload_tsv": f"SELECT user_id || '<tab><tab>' || array_to_string(tokens[1:8], '|') AS line FROM ({_TOKENS20})",
    "index_reload": TOPK_SQL + "5",
    "category_report": REPORT_SQL,
    "refused_report": REFUSED_SQL,
    "structure_similarity": STRUCTURE_SQL,
    "group_similarity": GROUP_SQL,
}
