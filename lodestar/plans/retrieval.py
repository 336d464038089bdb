"""Item profile, percentiles, categories, similar items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import curves as fc
from lodestar.functions import sequences as fs
from lodestar.operators import discovery, space, store
from lodestar.operators.workspace import versioned
from lodestar.sources import bindings as b

COLUMNS = [c for _, cols in space.GROUPS.values() for c in cols]
#: A category: targets of percentiles, and hard filters.
TARGETS = {"p_retailprice": 0.85, "quantity_mean": 0.3, "discount_mean": 0.6, "tax_mean": 0.5}
LONG_SQL = f"(SELECT item_id, col, value, cume_dist() OVER (PARTITION BY col ORDER BY value) AS p FROM (UNPIVOT (SELECT item_id, {', '.join(COLUMNS)} FROM items) ON {', '.join(COLUMNS)} INTO NAME col VALUE value))"
SPACE_SQL = f"WITH items AS ({b.ITEM_SQL}), long AS {LONG_SQL}, space AS (SELECT i.item_id, flagged, brand, " + ", ".join(f"max(CASE WHEN col = '{c}' THEN p END) AS {c}" for c in COLUMNS) + " FROM items i LEFT JOIN long l ON i.item_id = l.item_id GROUP BY 1, 2, 3)"


def _space(spark: SparkSession, sf: str) -> DataFrame:
    """Items in percentile space, kept by the version of the tables they come from."""
    build = lambda: space.space(b.item_profile(spark, sf), COLUMNS, keep=("flagged", "brand"))
    return versioned(spark, "space", [f"{sf}/part.parquet", f"{sf}/lineitem.parquet"], build)


def null_mean_sql(terms: list[str]) -> str:
    n = " + ".join(f"CASE WHEN {t} IS NULL THEN 0 ELSE 1 END" for t in terms)
    return f"(({' + '.join(f'coalesce({t}, 0.0)' for t in terms)}) / nullif({n}, 0))"


CLOSE_SQL = "round(1 - " + null_mean_sql([f"abs({c} - {t})" for c, t in TARGETS.items()]) + ", 4)"


def item_profile(spark, sf):
    return b.item_profile(spark, sf)


def cdf_percentile_long(spark, sf):
    return space.percentiles_long(b.item_profile(spark, sf), COLUMNS).select("item_id", "col", F.round("p", 9).alias("p"))


def category_rank(spark, sf):
    return space.rank_category(_space(spark, sf), TARGETS).select("item_id", "score")


def category_top(spark, sf):
    """A report of 30 rows."""
    return space.rank_category(_space(spark, sf), TARGETS, limit=30).select("item_id", "score")


def category_numeric_bounds(spark, sf):
    items = b.item_profile(spark, sf)
    keep = space.hard_filter({"p_size_min": 10, "tax_mean_max": 0.04, "absent_min": 3}, items.columns)
    return items.filter(keep).select("item_id", "p_size", "tax_mean")


def category_presence_filter(spark, sf):
    items = b.item_profile(spark, sf)
    return items.filter(space.hard_filter({"unflagged": True, "flagged": 0}, items.columns)).select("item_id", "flagged")


def category_tag_filter(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.filter(space.hard_filter({"lang_is": " FR "}, docs.columns)).select("doc_id", "lang", "source")


def category_tag_report(spark, sf):
    docs = b.table(spark, sf, "documents")
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(f"{c}_missing")
    return docs.agg(F.count(F.lit(1)).alias("n"), missing("lang"), missing("source"))


def category_support(spark, sf):
    return space.support(_space(spark, sf), TARGETS)


def category_scored_dims(spark, sf):
    sp = _space(spark, sf)
    got = sp.agg(*(F.count(c).alias(c) for c in TARGETS))
    return got.unpivot([], list(TARGETS), "col", "n").select("col", "n", (F.col("n") > 0).alias("scored"))


def member_pool(spark, sf):
    members = b.item_profile(spark, sf).filter("p_size > 25").select("item_id")
    return _space(spark, sf).join(members, "item_id", "left_semi").transform(lambda d: space.rank_category(d, TARGETS)).select("item_id", "score")


def category_dedupe(spark, sf):
    """The 30 choices of the category, near-duplicates suppressed, among all its rows."""
    ranked = space.rank_category(_space(spark, sf), TARGETS).select("item_id", "score")
    return space.deduplicate_all(ranked.join(b.vectors(spark, sf).select("item_id", "vector"), "item_id", "left").persist(), 30)


def _seeds(spark, sf) -> DataFrame:
    return b.vectors(spark, sf).filter("item_id % 10 = 0").select("item_id")


def vector_topk(spark, sf):
    v = b.vectors(spark, sf)
    q = v.filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return space.vector_topk(v, q, 20)


TOPK_SQL = """SELECT query_id, item_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(least(1.0, greatest(0.0, (list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1) / 2)), 6) AS similarity
 FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 10 = 0)) WHERE rank <= """


def similar_items(spark, sf):
    got = space.similar(_space(spark, sf).drop("brand"), b.vectors(spark, sf), _seeds(spark, sf))
    return got.select("query_id", "item_id", "rank", "score", "reasons")


_SIMS = {}
for _g, (_w, _cols) in space.GROUPS.items():
    _s = "least(1.0, greatest(0.0, 1 - " + null_mean_sql([f"abs(a.{c} - b.{c})" for c in _cols]) + "))"
    _SIMS[_g] = (_w, f"CASE WHEN {null_mean_sql([f'abs(a.{c} - b.{c})' for c in _cols])} IS NULL THEN NULL " + ("WHEN a.flagged = 1 AND b.flagged = 1 THEN " + _s + " END" if _g in space.FLAGGED_GROUPS else "ELSE " + _s + " END"))
_ALL = {"embedding": (space.EMBEDDING_WEIGHT, "similarity")} | _SIMS
_NUM = " + ".join(f"coalesce({w} * s_{g}, 0.0)" for g, (w, _) in _ALL.items())
_DEN = " + ".join(f"CASE WHEN s_{g} IS NULL THEN 0.0 ELSE {w} END" for g, (w, _) in _ALL.items())
_REASONS = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'c': -round({w} * s_{g}, 6), 'g': '{g}', 's': s_{g}}}" for g, (w, _) in _ALL.items()) + "], lambda x: x.s IS NOT NULL AND (x.g = 'embedding' OR x.s >= 0.6)))[1:4], lambda x: x.g), ',')"
SIMILAR_SQL = SPACE_SQL + f""", pool AS ({TOPK_SQL}200), sims AS (SELECT query_id, pool.item_id, {', '.join(f'{e} AS s_{g}' for g, (_, e) in _ALL.items())} FROM pool JOIN space a ON a.item_id = query_id JOIN space b ON b.item_id = pool.item_id),
 scored AS (SELECT *, round(({_NUM}) / nullif({_DEN}, 0), 4) AS score FROM sims)
 SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, score, {_REASONS} AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored) WHERE rank <= 20"""


def _sequence_pairs(spark, sf) -> DataFrame:
    """Pairs of users next to each other in id, whatever the number of users; at most 120 evenly spaced tokens of each."""
    t = b.token_sequences(spark, sf).withColumn("tokens", fs.cap_sequence(F.col("tokens")))
    return t.select(F.col("user_id").alias("u1"), F.col("tokens").alias("x")).join(t.select((F.col("user_id") - 1).alias("u1"), F.col("tokens").alias("y")), "u1")


def sequence_similarity(spark, sf):
    got = _sequence_pairs(spark, sf).select("u1", fs.similarities(F.col("x"), F.col("y")).alias("s"))
    return got.select("u1", *(F.round(f"s.{n}", 6).alias(n) for n in ("lev", "jac", "gram", "trans", "combined")))


_TIMES = "len(list_filter({0}, lambda z: z = k))"
SEQ_SQL = f"""WITH t AS ({b.SEQUENCE_SQL}), p AS (SELECT a.user_id AS u1, a.tokens AS x, c.tokens AS y FROM t a JOIN t c ON c.user_id = a.user_id + 1),
 g AS (SELECT *, list_transform(range(1, len(x)), lambda i: x[i] || '>' || x[i + 1]) AS gx, list_transform(range(1, len(y)), lambda i: y[i] || '>' || y[i + 1]) AS gy FROM p),
 gc AS (SELECT u1, sum(least(ca, cb)) AS common FROM (SELECT u1, k, count(*) AS ca FROM (SELECT u1, unnest(gx) AS k FROM g) GROUP BY 1, 2) JOIN (SELECT u1, k, count(*) AS cb FROM (SELECT u1, unnest(gy) AS k FROM g) GROUP BY 1, 2) USING (u1, k) GROUP BY 1),
 s AS (SELECT g.u1, 1 - levenshtein(array_to_string(x, ''), array_to_string(y, '')) / CAST(greatest(len(x), len(y)) AS DOUBLE) AS lev,
  len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE) AS jac, coalesce(common, 0) / CAST(len(gx) + len(gy) - coalesce(common, 0) AS DOUBLE) AS gram FROM g LEFT JOIN gc ON gc.u1 = g.u1)
 SELECT u1, round(lev, 6) AS lev, round(jac, 6) AS jac, round(gram, 6) AS gram, round(gram, 6) AS trans, round(0.35 * lev + 0.45 * gram + 0.2 * jac, 6) AS combined FROM s"""


def cap_sequence(spark, sf):
    t = b.token_sequences(spark, sf)
    return t.select("user_id", F.array_join(fs.cap_sequence(F.col("tokens"), 24), "").alias("tokens"))


CAP_SQL = f"""SELECT user_id, CASE WHEN len(tokens) > 24 THEN array_to_string(list_transform(list_sort(list_distinct(list_transform(range(24), lambda i: CAST(round_even(i * ((len(tokens) - 1) / 23.0), 0) AS INTEGER)))), lambda i: tokens[i + 1]), '') ELSE array_to_string(tokens, '') END AS tokens FROM ({b.SEQUENCE_SQL})"""


def relative_tokens(spark, sf):
    t = b.token_sequences(spark, sf)
    roots = F.transform("tokens", lambda c: F.ascii(c) - 90)
    return t.select("user_id", F.array_join(fs.relative_tokens(roots, F.col("tokens"), F.lit(9)), " ").alias("relative"))


def curve_pearson(spark, sf):
    c = b.curves(spark, sf)
    pairs = c.select(F.col("user_id").alias("u1"), F.col("curve").alias("x")).join(c.select((F.col("user_id") - 1).alias("u1"), F.col("curve").alias("y")), "u1")
    return pairs.select("u1", F.round(fc.pearson(F.col("x"), F.col("y")), 6).alias("r"), F.round(fc.correlation_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


PEARSON_SQL = f"""WITH c AS ({b.CURVE_SQL}), p AS (SELECT a.user_id AS u1, unnest(a.curve) AS x, unnest(d.curve) AS y FROM c a JOIN c d ON d.user_id = a.user_id + 1)
 SELECT u1, round(corr(x, y), 6) AS r, round(least(1.0, greatest(0.0, (corr(x, y) + 1) / 2)), 6) AS similarity FROM p GROUP BY u1"""


def duration_profile(spark, sf):
    c = b.curves(spark, sf)
    prof = fc.duration_profile(F.filter("curve", lambda v: v > 0))
    return c.select("user_id", F.posexplode(prof).alias("pos", "v")).select("user_id", "pos", F.round("v", 6).alias("share"))


DURATION_SQL = f"""WITH c AS (SELECT user_id, list_filter(curve, lambda v: v > 0) AS r FROM ({b.CURVE_SQL})), s AS (SELECT user_id, r, list_transform(range(1, len(r) + 1), lambda i: list_sum(r[1:i])) AS cum FROM c),
 k AS (SELECT user_id, cum, CAST(i AS INTEGER) AS pos, i * (len(r) - 1) / 7.0 AS place FROM s, unnest(range(8)) AS q(i) WHERE len(r) > 0),
 l AS (SELECT *, least(CAST(floor(place) AS INTEGER), greatest(len(cum) - 2, 0)) AS low FROM k)
 SELECT user_id, pos, round((cum[low + 1] + (coalesce(cum[low + 2], cum[low + 1]) - cum[low + 1]) * (place - low)) / cum[len(cum)], 6) AS share FROM l"""


def display_join(spark, sf):
    top = space.rank_category(_space(spark, sf), TARGETS).select("item_id", "score")
    names = b.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand")
    return top.join(names.filter("item_id % 3 <> 0"), "item_id", "left").select("item_id", "score", F.coalesce("p_name", F.lit("")).alias("name"))


def tag_suffix(spark, sf):
    """Brands as clusters: their commonest type, its coverage and purity."""
    items = b.item_profile(spark, sf)
    n = items.groupBy("brand", "type").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("brand")
    ranked = n.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "type"))})
    return ranked.filter("r = 1").select("brand", "type", F.round(F.col("n") / F.col("total"), 6).alias("purity"), (F.col("n") / F.col("total") >= 0.7).alias("named"))


def silhouette(spark, sf):
    return discovery.silhouette(b.vectors(spark, sf).withColumn("label", F.col("label")))


SILHOUETTE_SQL = """WITH d AS (SELECT a.vec_id AS i, a.label AS own, c.label AS other, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS d FROM embeddings a JOIN embeddings c ON a.vec_id <> c.vec_id GROUP BY 1, 2, 3),
 e AS (SELECT i, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM d GROUP BY i) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0.0)), 6) AS silhouette FROM e"""


def cluster_names(spark, sf):
    items = b.item_profile(spark, sf)
    long = space.percentiles_long(items, COLUMNS)
    return discovery.name_clusters(long, items.select("item_id", F.col("brand").alias("cluster")), least=0.02)


NAMES_SQL = f"""WITH items AS ({b.ITEM_SQL}), long AS {LONG_SQL}, m AS (SELECT brand AS cluster, col, round(avg(p) - 0.5, 6) AS dev FROM long JOIN items USING (item_id) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(dev) DESC, col) AS r, max(CASE WHEN abs(dev) >= 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster) AS clear FROM m)
 SELECT cluster, string_agg(CASE WHEN dev >= 0 THEN '+' ELSE '-' END || col, '·' ORDER BY r) AS name, (SELECT count(*) FROM items WHERE brand = cluster) AS size FROM r WHERE CASE WHEN clear = 1 THEN abs(dev) >= 0.02 AND r <= 3 ELSE r <= 2 END GROUP BY cluster"""


def kmeans_discover(spark, sf):
    return discovery.discover(_space(spark, sf), COLUMNS)[0]


def pca_embed(spark, sf):
    items = b.item_profile(spark, sf)
    return discovery.PcaEmbedder(8).fit(items, COLUMNS).embed(items)


def evaluation_stats(spark, sf):
    return store.evaluation_stats(b.table(spark, sf, "labels"), "quality")


QUERIES = {f.__name__: f for f in (item_profile, cdf_percentile_long, category_rank, category_top, category_numeric_bounds, category_presence_filter, category_tag_filter, category_tag_report, category_support, category_scored_dims, member_pool, category_dedupe, vector_topk, similar_items, sequence_similarity, cap_sequence, relative_tokens, curve_pearson, duration_profile, display_join, tag_suffix, silhouette, cluster_names, kmeans_discover, pca_embed, evaluation_stats)}
_RANK = f"SELECT item_id, {CLOSE_SQL} AS score FROM space"
ORACLE_SQL = {
    "item_profile": b.ITEM_SQL,
    "cdf_percentile_long": f"WITH items AS ({b.ITEM_SQL}) SELECT item_id, col, round(p, 9) AS p FROM {LONG_SQL}",
    "category_rank": SPACE_SQL + f" SELECT * FROM ({_RANK}) WHERE score IS NOT NULL",
    "category_top": SPACE_SQL + f" SELECT * FROM ({_RANK}) WHERE score IS NOT NULL ORDER BY score DESC, item_id LIMIT 30",
    "category_numeric_bounds": f"SELECT item_id, p_size, tax_mean FROM ({b.ITEM_SQL}) WHERE p_size >= 10 AND tax_mean <= 0.04",
    "category_presence_filter": f"SELECT item_id, flagged FROM ({b.ITEM_SQL}) WHERE flagged = 0",
    "category_tag_filter": "SELECT doc_id, lang, source FROM documents WHERE lower(trim(lang)) = 'fr'",
    "category_tag_report": "SELECT count(*) AS n, count(*) FILTER (WHERE lang IS NULL OR lang = '') AS lang_missing, count(*) FILTER (WHERE source IS NULL OR source = '') AS source_missing FROM documents",
    "category_support": SPACE_SQL + ", d AS (SELECT " + null_mean_sql([f"abs({c} - {t})" for c, t in TARGETS.items()]) + " AS d FROM space), a AS (SELECT count(*) AS pool, count(*) FILTER (WHERE d <= 0.25) AS support FROM d WHERE d IS NOT NULL) SELECT pool, support, greatest(5, CAST(round_even(pool * 0.05, 0) AS BIGINT)) AS min_support, support < greatest(5, CAST(round_even(pool * 0.05, 0) AS BIGINT)) AS low_support FROM a",
    "category_scored_dims": SPACE_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS n, count({c}) > 0 AS scored FROM space" for c in TARGETS),
    "member_pool": SPACE_SQL + f" SELECT s.* FROM ({_RANK}) s JOIN items USING (item_id) WHERE p_size > 25 AND score IS NOT NULL",
    "vector_topk": TOPK_SQL + "20",
    "similar_items": SIMILAR_SQL,
    "sequence_similarity": SEQ_SQL,
    "cap_sequence": CAP_SQL,
    "relative_tokens": f"SELECT user_id, array_to_string(list_transform(tokens, lambda c: CAST((ascii(c) - 99 + 120) % 12 AS VARCHAR) || ':' || c), ' ') AS relative FROM ({b.SEQUENCE_SQL})",
    "curve_pearson": PEARSON_SQL,
    "duration_profile": DURATION_SQL,
    "display_join": SPACE_SQL + f" SELECT s.item_id, s.score, coalesce(p_name, '') AS name FROM ({_RANK}) s LEFT JOIN part ON p_partkey = s.item_id AND p_partkey % 3 <> 0 WHERE score IS NOT NULL",
    "tag_suffix": "SELECT brand, type, round(n / total, 6) AS purity, n / total >= 0.7 AS named FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, type) AS r FROM (SELECT p_brand AS brand, p_type AS type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY p_brand) AS DOUBLE) AS total FROM part GROUP BY 1, 2)) WHERE r = 1",
    "silhouette": SILHOUETTE_SQL,
    "cluster_names": NAMES_SQL,
    "evaluation_stats": "SELECT count(*) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS positive, round(sum(quality) / CAST(count(*) AS DOUBLE), 6) AS agreement FROM labels",
}
