"""Queries against their SQL, and what SQL can't express against plain code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as ft
from lodestar.operators import discovery, interest, series, signal, space
from lodestar.queries import ORACLE_SQL, QUERIES
from lodestar.streaming import interest as stream
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF)


def test_topk_prunes_and_negative_control(spark):
    got = QUERIES["similar_items"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    first = {(r.query_id, r["rank"]): r.item_id for r in got.collect()}
    old = space.GROUPS["energy"]
    try:
        space.GROUPS["energy"] = (5.0, old[1])
        other = {(r.query_id, r["rank"]): r.item_id for r in QUERIES["similar_items"](spark, SF).collect()}
    finally:
        space.GROUPS["energy"] = old
    assert first != other


def test_scores_round_as_sql_does(spark, tmp_path):
    """Pairs whose scores and contributions often stand on a half of the last place."""
    import duckdb

    from lodestar.plans import retrieval

    rng, n = np.random.default_rng(0), 300_000
    p = pd.DataFrame({f"{s}{c}": rng.integers(1, 201, n) / 200 for s in "ab" for c in retrieval.COLUMNS})
    p = p.assign(aflagged=rng.integers(0, 2, n), bflagged=rng.integers(0, 2, n), similarity=rng.integers(0, 1_000_001, n) / 1e6, i=range(n))
    p.to_parquet(tmp_path / "p.parquet")
    got = space.pair_scores(spark.read.parquet(str(tmp_path / "p.parquet")), "a", "b", "similarity").select("i", "score", space.reasons().alias("reasons")).toPandas()
    sides = ", ".join(f"{{{', '.join(repr(c) + ': ' + s + c for c in (*retrieval.COLUMNS, 'flagged'))}}} AS {s}" for s in "ab")
    sims = ", ".join(f"{e} AS s_{g}" for g, (_, e) in retrieval._ALL.items())
    sql = f"SELECT i, round(({retrieval._NUM}) / nullif({retrieval._DEN}, 0), 4) AS score, {retrieval._REASONS} AS reasons FROM (SELECT i, {sims} FROM (SELECT i, similarity, {sides} FROM p))"
    both = got.merge(duckdb.sql(sql).df(), on="i", suffixes=("", "_sql"))
    assert len(both) == n and (both.score == both.score_sql).all() and (both.reasons == both.reasons_sql).all()


def test_groups_without_common_columns_drop_out(spark, tmp_path):
    """Parts without lines: what two items don't both have weighs nothing, as in SQL, rather than counting as unlike."""
    import duckdb

    from lodestar.plans import retrieval

    src, out = "/root/testdata/sf0.01", str(tmp_path)
    duckdb.sql(f"COPY (SELECT * FROM '{src}/lineitem.parquet' WHERE l_partkey % 3 <> 0) TO '{out}/lineitem.parquet'")
    for t in ("part", "embeddings"):
        duckdb.sql(f"COPY (SELECT * FROM '{src}/{t}.parquet') TO '{out}/{t}.parquet'")
    con = duckdb.connect()
    for t in ("part", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    got = QUERIES["similar_items"](spark, out).toPandas()
    both = got.merge(con.execute(retrieval.SIMILAR_SQL).df(), on=["query_id", "rank"], suffixes=("", "_sql"))
    assert len(both) == len(got) > 0 and all((both[c] == both[f"{c}_sql"]).all() for c in ("item_id", "score", "reasons"))
    one = spark.createDataFrame([(0.2, None, 0.4, 0.4)], "ap_retailprice double, bp_retailprice double, ap_size double, bp_size double")
    g = one.select(space.group_similarity("a", "b", ("p_retailprice",)), space.group_similarity("a", "b", ("p_size",))).first()
    assert g[0] is None and g[1] == 1


def test_vector_similarities_add_up_as_sql_does(spark, tmp_path):
    """Inner products that end on a half of the sixth place, or next to it by the order of their terms."""
    import duckdb

    rng = np.random.default_rng(1)
    x = rng.integers(-40, 41, (400, 16)) / 1000 * np.where(np.arange(16) % 2, 1.0, 0.5)
    rows = pd.DataFrame({"vec_id": range(400), "embedding": list(x)})
    rows.to_parquet(tmp_path / "v.parquet")
    v = spark.read.parquet(str(tmp_path / "v.parquet")).withColumnsRenamed({"vec_id": "item_id", "embedding": "vector"})
    got = space.vector_topk(v, v.filter("item_id % 10 = 0").withColumnRenamed("item_id", "query_id"), 20).toPandas()
    from lodestar.plans import retrieval

    con = duckdb.connect()
    con.register("embeddings", rows)
    both = got.merge(con.execute(retrieval.TOPK_SQL + "20").df(), on=["query_id", "rank"], suffixes=("", "_sql"))
    assert len(both) == 800 and (both.item_id == both.item_id_sql).all() and (both.similarity == both.similarity_sql).all()


def test_sequences_reach_past_120_events(spark, tmp_path):
    from lodestar.sources import bindings

    kinds, n = list(bindings.TOKENS), 500
    rows = [(u * 1000 + i, u, kinds[4 if i == n - 1 else i * 4 // n], i) for u in (1, 2) for i in range(n)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(f"{tmp_path}/events.parquet")
    whole = "".join(bindings.TOKENS[r[2]] for r in rows[:n])
    even = [whole[round(i * (n - 1) / 119)] for i in range(120)]
    assert ["".join(r.tokens) for r in bindings.token_sequences(spark, str(tmp_path)).collect()] == [whole] * 2
    got = {r.user_id: r.tokens for r in QUERIES["cap_sequence"](spark, str(tmp_path)).collect()}
    assert got[1] == "".join(whole[round(i * (n - 1) / 23)] for i in range(24)) and got[1][-1] == "e"
    assert len(QUERIES["relative_tokens"](spark, str(tmp_path)).first().relative.split()) == n
    pair = __import__("lodestar.plans.retrieval", fromlist=["x"])._sequence_pairs(spark, str(tmp_path)).first()
    assert pair.x == pair.y == even and QUERIES["sequence_similarity"](spark, str(tmp_path)).first().combined == 1


def test_dedupe_rejects_near_copies(spark):
    rows = [(1, i, 1 - i / 100, [1.0, 0.001 * i] if i < 5 else [float(np.cos(i)), float(np.sin(i))]) for i in range(12)]
    got = space.deduplicate(spark.createDataFrame(rows, "list_id bigint, item_id bigint, score double, vector array<double>"), 5).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and sum(r.item_id < 5 for r in got) == 1


def test_exclude_history_makes_no_pairs(spark):
    for name in ("exclude_history", "exclude_history_all"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feed_against_loop(spark):
    got = QUERIES["feed_mmr"](spark, SF).toPandas()
    assert got.groupby("user_id")["rank"].max().le(20).all() and not got.duplicated(["user_id", "item_id"]).any()


def test_discovery(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *[float(np.clip(v + rng.uniform(-0.05, 0.05), 0, 1)) for v in c]) for i, c in enumerate([(0.9, 0.1), (0.1, 0.9), (0.9, 0.9), (0.1, 0.1)] * 15)]
    got, status = discovery.discover(spark.createDataFrame(rows, "item_id bigint, x double, y double"), ["x", "y"])
    pdf = got.toPandas().sort_values("item_id")
    assert status["k"] == 4 and all(pdf.cluster[pdf.item_id % 4 == k].nunique() == 1 for k in range(4))
    assert discovery.discover(spark.createDataFrame(rows[:6], "item_id bigint, x double, y double"), ["x", "y"])[1]["status"] == "library-too-small"


def test_discovery_uses_every_row(spark):
    rng = np.random.default_rng(3)
    centres = np.array([(0.9, 0.1), (0.1, 0.9), (0.9, 0.9), (0.1, 0.1)])
    x = centres[np.arange(7000) % 4] + rng.uniform(-0.25, 0.25, (7000, 2))
    got, status = discovery.discover(spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"]).assign(item_id=range(7000))), ["x", "y"])
    own = got.toPandas().sort_values("item_id").cluster.to_numpy() - 1
    mean = np.stack([x[own == k].mean(0) for k in range(status["k"])])
    assert len(own) == 7000 and np.bincount(own).min() >= 280 and (((x[:, None] - mean[None]) ** 2).sum(-1).argmin(1) == own).mean() > 0.999
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    per = np.stack([d[:, own == k].sum(1) for k in range(status["k"])], axis=1)
    size, at = np.bincount(own), np.arange(7000)
    a = per[at, own] / (size[own] - 1)
    per = per / size
    per[at, own] = np.inf
    b = per.min(1)
    assert abs(((b - a) / np.maximum(a, b)).mean() - status["silhouette"]) < 1e-6


def test_silhouettes_in_single_precision(spark, monkeypatch):
    """Sums by chunks of rows of the same clusters, by rows, and by both, against all distances; near ties are decided in double precision."""
    for size, ks in ((60, (4, 5)), (3000, (4, 5)), (3000, (4, 5, 6, 7))):
        rng = np.random.default_rng(size)
        x, n = rng.random((size, 5)), rng.integers(1, 4, size).astype(float)
        own = {k: ((x[:, None] - x[:k][None]) ** 2).sum(-1).argmin(1) for k in ks}
        fits = {k: (x[:k], np.bincount(own[k], n, k)) for k in ks}
        rows = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(zip(x.tolist(), n.tolist(), strict=True))], "h bigint, x array<double>, n double").persist()
        d, at, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * n, np.arange(size), {}
        for k in ks:
            per = np.stack([d[:, own[k] == j].sum(1) for j in range(k)], axis=1)
            mine = fits[k][1][own[k]]
            a, per = per[at, own[k]] / np.maximum(mine - 1, 1), per / fits[k][1]
            per[at, own[k]] = np.inf
            b = per.min(1)
            want[k] = float(n @ np.where(mine > 1, (b - a) / np.maximum(a, b), 0) / n.sum())
        monkeypatch.setattr(discovery, "BLOCK", 1100)
        exact, single = (discovery._silhouettes(rows, int(n.sum()), fits, single=v) for v in (False, True))
        assert all(abs(exact[k] - want[k]) < 1e-7 and 0 < abs(single[k] - want[k]) < 0.03 / size for k in ks), (want, exact, single)
    monkeypatch.setattr(discovery, "DOUBLE", 100)
    assert discovery._qualities(rows, int(n.sum()), fits) == pytest.approx(single, abs=1e-6)
    monkeypatch.setattr(discovery, "CLOSE", 2.0)
    assert discovery._qualities(rows, int(n.sum()), fits) == pytest.approx(exact, abs=1e-10)


def test_discovery_computes_equal_rows_once(spark, monkeypatch):
    """Rows that occur many times count as often, and cost as one."""
    rng = np.random.default_rng(4)
    x = (np.array([(0.9, 0.1), (0.1, 0.9), (0.9, 0.9), (0.1, 0.1)])[np.arange(80) % 4] + rng.uniform(-0.3, 0.3, (80, 2)))[np.repeat(np.arange(80), np.arange(80) % 7 + 20)]
    seen = []
    inner = discovery._lloyd
    monkeypatch.setattr(discovery, "_lloyd", lambda dense, *a: seen.append(dense.count()) or inner(dense, *a))
    got, status = discovery.discover(spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "item_id bigint, x double, y double"), ["x", "y"])
    own = got.toPandas().sort_values("item_id").cluster.to_numpy() - 1
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    size, at = np.bincount(own), np.arange(len(x))
    per = np.stack([d[:, own == k].sum(1) for k in range(status["k"])], axis=1)
    a, per = per[at, own] / (size[own] - 1), per / size
    per[at, own] = np.inf
    b = per.min(1)
    assert seen == [80] and status["n"] == len(own) == len(x) and abs(((b - a) / np.maximum(a, b)).mean() - status["silhouette"]) < 1e-6
    mean = np.stack([x[own == k].mean(0) for k in range(status["k"])])
    assert (((x[:, None] - mean[None]) ** 2).sum(-1).argmin(1) == own).mean() > 0.99


def test_pca_cosines(spark):
    x = np.random.default_rng(1).standard_normal((40, 5))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(item_id=range(40)))
    model = discovery.PcaEmbedder(5).fit(df, list("abcde"))
    got = np.stack(discovery.PcaEmbedder.from_table(model.to_table(spark)).embed(df).toPandas().sort_values("item_id").vector.to_numpy())
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.svd(z, full_matrices=False)[0]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, w @ w.T, atol=1e-6)


def test_text():
    lex = {"energy": (["激烈", "有力"], ["安静"]), "tempo": (["快"], ["慢"])}
    got = ft.parse("不要激烈的，很慢的爵士", lex)
    assert got["query"] == {"energy": 0.15, "tempo": 0.15} and got["unmatched"] == ["爵士"]
    assert [w for _, w in ft.match_terms("abcab", ["ab", "abc"])] == ["abc", "ab"] or ft.match_terms("abcab", ["ab", "abc"]) == [(0, "ab"), (0, "abc")]


def test_text_column(spark):
    df = spark.createDataFrame([("不要激烈 有力",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(ft.matches_column(F.col("t"), ["激烈", "有力", "力"])).collect()]
    assert got[0] == "激烈,有力" and got[1] == ""


def test_peaks():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 0, 0.1, 0], float)
    assert series.find_peaks(x, 0.5, 1) == [(1, 1.0), (3, 3.0), (5, 2.0)] and [p for p, _ in series.find_peaks(x, 0.5, 3)] == [3]


def test_stream_equals_batch(spark, tmp_path):
    now = 1_706_659_200.0
    log = QUERIES["decay_weight"] and __import__("lodestar.sources.bindings", fromlist=["x"]).interactions(spark, SF).select("event_id", "user_id", "item_id", "event", "epoch_s", "completion")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.append_log(stream.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination()
    key = lambda df: {(r.user_id, r.scope, r.item_id): round(r.w, 9) for r in df.collect()}
    assert key(stream.current_weights(spark, str(tmp_path / "log"), now)) == key(interest.scope_weights(log, now))
    mass = stream.decayed_sums(log).filter("event = 'like'").agg(F.sum(F.col("mass") * F.exp((F.col("bucket") - now) / 604800.0))).first()[0]
    assert abs(mass - log.filter("event = 'like'").agg(F.sum(interest.event_weight(now))).first()[0]) < 1e-6


def test_signal(spark):
    clips = [(f"f{f}-{s}", signal.synthesise(f, s)) for f in range(4) for s in range(3)]
    got = signal.extract_features(spark.createDataFrame([*clips, ("bad", b"x")], "path string, content binary")).toPandas().set_index("path")
    assert got.error.notna().sum() == 1 and got.error["bad"]
    cols = ["centroid", "bandwidth", "low_share", "mid_share", "rms_std"]
    z = got.drop("bad")[cols].astype(float)
    z = (z - z.mean()) / z.std()
    d = ((z.to_numpy()[:, None] - z.to_numpy()[None]) ** 2).sum(-1) + np.eye(len(z)) * 1e9
    assert np.mean([z.index[i][1] == z.index[j][1] for i, j in enumerate(d.argmin(1))]) >= 0.8
    profile = np.zeros(12)
    profile[[2, 6, 9]] = (1, 0.8, 0.9)
    assert signal.key_mode(profile) == ("D", "major")
    assert signal.repeat_groups(np.array([[1, 0, 0], [0, 1, 0]] * 3, float)) == "ABABAB"
    assert signal.stereo(np.zeros((1, 9000)))["status"] == "mono" and signal.stereo(np.zeros((2, 9000)))["status"] == "silent"


def test_signal_sees_the_whole_track():
    rate, out = 8000, __import__("io").BytesIO()
    t = np.arange(90 * rate) / rate
    y = np.where(t < 60, 0.9 * np.sin(2 * np.pi * 220 * t), 0.02 * np.sin(2 * np.pi * 330 * t))
    with __import__("wave").open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((y * 32767).astype("<i2").tobytes())
    got = signal.extract(out.getvalue())
    curve = np.array(got["energy_curve"])
    assert len(curve) == 180 and curve[:118].min() > 0.5 and curve[122:].max() < 0.05
    assert got["dynamic_range"] > 0.5 and abs(got["rms_mean"] - (0.9 * 2 + 0.02) / 3 / np.sqrt(2)) < 0.01
    assert got["sections"][0] == 0 and got["sections"][-1] == 90 and any(abs(e - 60) <= 1 for e in got["sections"]) and len(got["repeats"]) == len(got["sections"]) - 1
