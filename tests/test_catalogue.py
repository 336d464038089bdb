"""Sequence kernel, feed, dedupe, sections, text requests, exports and tables by version against plain code."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import sequences as fs
from lodestar.functions import text as ft
from lodestar.operators import catalogue, discovery, interest, series, space, structure, workspace
from lodestar.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_similarity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    lev = 1 - d[-1] / max(len(a), len(b)) if a or b else 1.0
    p, q = (collections.Counter(zip(s, s[1:], strict=False)) for s in (a, b))
    gram = sum((p & q).values()) / sum((p | q).values()) if p or q else 1.0
    jac = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    return lev, gram, jac, 0.35 * lev + 0.45 * gram + 0.2 * jac if a and b else 0.0


def test_sequence_kernel_for_any_tokens(spark):
    rng = np.random.default_rng(11)
    kinds = [[str(i) for i in range(-12, 13)], ["0:maj", "7:min", "5:maj", "a>b", "b"], ["x", "xx", "x x", "é", "𝒳"]]
    seq = lambda k: [kinds[k][i] for i in rng.integers(0, len(kinds[k]), int(rng.integers(0, 130)))]
    pairs = [(k, seq(k % 3), seq(k % 3)) for k in range(120)] + [(200, [], []), (201, ["a"], []), (202, ["a>b", "c"], ["a", "b>c"]), (203, ["0:maj", "7:min"], ["0:maj", "5:maj"])]
    df = spark.createDataFrame(pairs, "k int, a array<string>, b array<string>")
    got = {r.k: r for r in df.select("k", fs.similarities(F.col("a"), F.col("b")).alias("s"), fs.ngram_similarity(F.col("a"), F.col("b"), 3).alias("g3"), fs.levenshtein_similarity(F.col("a"), F.col("b")).alias("lev")).collect()}
    for k, a, b in pairs:
        lev, gram, jac, combined = plain_similarity(a, b)
        s = got[k].s
        assert np.allclose((s.lev, s.gram, s.jac, s.trans, s.combined, got[k].lev), (lev, gram, jac, gram, combined, lev)), (k, a, b)
        p, q = (collections.Counter(zip(x, x[1:], x[2:], strict=False)) for x in (a, b))
        assert np.isclose(got[k].g3, sum((p & q).values()) / sum((p | q).values()) if p or q else 1.0)
    assert got[203].s.lev == 0.5


def test_percentiles_by_ranges_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 40)) if i % 7 else None, float(i % 3)) for i in range(5000)]
    df = spark.createDataFrame(rows, "item_id bigint, a double, b double")
    monkeypatch.setattr(space, "RANGE_ROWS", 300)
    got = {(r.item_id, r.col): r.p for r in space.percentiles_long(df, ["a", "b"]).collect()}
    for j, c in ((1, "a"), (2, "b")):
        known = np.sort([r[j] for r in rows if r[j] is not None])
        assert all(got[r[0], c] == np.searchsorted(known, r[j], "right") / len(known) for r in rows if r[j] is not None)
    assert len(got) == sum(r[1] is not None for r in rows) + len(rows)


def test_topk_and_silhouette_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = rng.integers(0, 3, 300)
    v = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))], "item_id bigint, vector array<double>, label int")
    monkeypatch.setattr(space, "MEET", (64, 16))
    got = collections.defaultdict(dict)
    for r in space.vector_topk(v, v.select(F.col("item_id").alias("query_id"), "vector"), 7).collect():
        got[r.query_id][r["rank"]] = r.item_id
    for i in range(300):
        s = np.round(np.clip((x @ x[i] + 1) / 2, 0, 1), 6)
        s[i] = -9
        assert [got[i][k] for k in range(1, 8)] == np.lexsort((np.arange(300), -s))[:7].tolist()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    mean = np.array([[d[i, (label == c) & (np.arange(300) != i)].mean() for c in range(3)] for i in range(300)])
    a = mean[np.arange(300), label]
    b = np.where(np.eye(3, dtype=bool)[label], np.inf, mean).min(1)
    assert discovery.silhouette(v).first()[0] == pytest.approx(float(((b - a) / np.maximum(a, b)).mean()), abs=1e-6)


def test_feed_against_a_loop(spark):
    n, dim = 24, 8
    unit = [[float(np.cos(2 * np.pi * i / n)), float(np.sin(2 * np.pi * i / n)), *([0.0] * (dim - 2))] for i in range(n)]
    rng = np.random.default_rng(6)
    pool = [(u, i, round(float(rng.random()), 3), round(float(rng.random()), 3)) for u in (1, 2) for i in range(n)] + [(1, 99, 0.9, 0.9)]
    recent = {1: [3, 7], 2: []}
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(unit)], "item_id bigint, vector array<double>")
    history = spark.createDataFrame([(u, i) for u, h in recent.items() for i in h], "user_id bigint, item_id bigint")
    got = collections.defaultdict(list)
    for r in interest.feed(spark.createDataFrame(pool, "user_id bigint, item_id bigint, similarity double, preference double"), history, vectors, 6).collect():
        got[r.user_id].append((r["rank"], r.item_id, r.score))
    for u, h in recent.items():
        cos = lambda i, j: sum(a * b for a, b in zip(unit[i], unit[j], strict=True)) if max(i, j) < n else None
        left, chosen, want = {i: (s, p) for w, i, s, p in pool if w == u and i not in h}, [], []
        while len(chosen) < 6:
            def worth(i):
                near = [cos(i, j) for j in h if cos(i, j) is not None]
                picked = [cos(i, j) for j in chosen if cos(i, j) is not None]
                return 0.55 * left[i][1] + 0.20 * left[i][0] + 0.15 * (1 - max(near) if near else 1) + 0.10 * (1 - max(picked) if picked else 1)
            best = max((i for i in left if i not in chosen), key=lambda i: (round(worth(i), 9), left[i][0], -i))
            want.append((len(chosen) + 1, best, round(worth(best), 6)))
            chosen.append(best)
        mine = sorted(got[u])
        assert [x[:2] for x in mine] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(mine, want, strict=True))


def test_cold_start_takes_euclidean_distance_and_least_similarity(spark):
    x = np.array([[4.0, 0.1], [0.1, 0.1], [0.0, 3.0], [-2.0, -0.5], [1.0, 1.2], [0.6, -3.0]])
    got = [r.item_id for r in interest.cold_start(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, vector array<double>"), 4).orderBy("rank").collect()]
    want = [int(np.argmin(np.linalg.norm(x - x.mean(0), axis=1)))]
    cos = lambda i, j: x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j]) + 1e-9)
    while len(want) < 4:
        want.append(min((i for i in range(6) if i not in want), key=lambda i: (min(cos(i, j) for j in want), i)))
    assert got == want


def test_dedupe_of_a_whole_pool_is_that_of_a_list(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 5))
    rows = [(i, round(1 - i / 500, 6), (base[i % 12] + 0.02 * rng.standard_normal(5)).tolist() if i % 17 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id bigint, score double, vector array<double>")
    for limit in (10, 40):
        one = space.deduplicate(df.withColumn("list_id", F.lit(1).cast("bigint")), limit).orderBy("rank").collect()
        assert [r.item_id for r in space.deduplicate_all(df, limit).orderBy("rank").collect()] == [r.item_id for r in one]
    assert space.deduplicate_all(df.limit(3), 5).count() == 3 and space.deduplicate_all(df.limit(0), 5).count() == 0


def test_section_parts_against_a_loop(spark):
    rows = QUERIES["section_labels"](spark, SF).collect()
    from lodestar.plans.catalogue import _sections

    tracks = collections.defaultdict(list)
    for r in _sections(spark, SF).collect():
        tracks[r.user_id].append(r)
    got = {(r.user_id, r.pos): (r.part, r.confidence) for r in rows}
    parts = collections.Counter()
    for user, segs in tracks.items():
        segs.sort(key=lambda r: r.pos)
        rank = lambda c: {s.pos: k / max(len(segs) - 1, 1) for k, s in enumerate(sorted(segs, key=lambda s: (s[c], s.pos)))}
        e, o = rank("energy"), rank("onset")
        groups = collections.defaultdict(list)
        for s in segs:
            groups[s.group].append(s.pos)
        mean = lambda d, g: sum(d[p] for p in groups[g]) / len(groups[g])
        good = [g for g, p in groups.items() if len(p) >= 2 and mean(e, g) >= 0.5 and mean(o, g) >= 0.4]
        chorus = max(good, key=lambda g: mean(e, g) * mean(o, g) * len(groups[g]) ** 0.5) if good else None
        for s in segs:
            reps, want = len(groups[s.group]), ("unknown", 0.0)
            if chorus is not None and s.group == chorus and e[s.pos] >= 0.5 and o[s.pos] >= 0.4:
                want = ("chorus", min(0.6, max(0.25, 0.2 + 0.14 * (reps - 1) + 0.5 * (e[s.pos] - 0.5) + 0.3 * (o[s.pos] - 0.4))))
            elif chorus is not None and s.group != chorus and reps >= 2 and e[s.pos] < mean(e, chorus):
                want = ("verse", min(0.54, max(0.2, 0.15 + 0.14 * (reps - 1) + 0.4 * (mean(e, chorus) - e[s.pos]))))
            elif s is segs[0] and e[s.pos] < 0.35 and o[s.pos] < 0.4:
                want = ("intro", min(0.5, 0.3 + 0.4 * (0.35 - e[s.pos])))
            elif s is segs[-1] and len(segs) > 2 and e[s.pos] < 0.35:
                want = ("outro", min(0.5, 0.3 + 0.4 * (0.35 - e[s.pos])))
            parts[want[0]] += 1
            assert got[user, s.pos][0] == want[0] and abs(got[user, s.pos][1] - want[1]) < 1e-3
    assert len(parts) >= 3, parts
    choruses = collections.Counter(u for (u, _), (p, _) in got.items() if p == "chorus")
    assert {r.user_id: r.choruses for r in QUERIES["chorus_summary"](spark, SF).collect()} == dict(choruses)


def test_section_families():
    rng = np.random.default_rng(0)
    base = rng.random((2, 16))
    x = np.array([base[i % 2] + 0.02 * rng.standard_normal(16) for i in range(8)])
    s = structure.family_similarity(x)
    assert s[0, 2] > 0.8 and s[0, 1] < 0 and np.allclose(np.diag(s), 1)
    flat = x.copy()
    flat[:, :12] = 1.0
    part = flat[:, 12:14] - flat[:, 12:14].mean(0)
    part /= np.linalg.norm(part, axis=1, keepdims=True)
    both = flat[:, 14:] - flat[:, 14:].mean(0)
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    assert np.allclose(structure.family_similarity(flat), (0.25 * part @ part.T + 0.15 * both @ both.T) / 0.4)
    assert not structure.family_similarity(np.ones((3, 16))).any()


def test_requests_in_words():
    languages, genres = {"英文": "en", "纯音乐": None}, {"摇滚": ("rock", {"energy": 0.8, "absent": 0.7})}
    registers = {"女声": ("high", {"pitch": 0.85}), "男声": ("low", {"absent": 0.2})}
    got = ft.tag_request("来点英文摇滚女声男声", languages, genres, registers, {"language": 3, "genre": 0}, {"energy", "pitch"})
    assert got["hard_filter"] == {"language_is": "en"} and got["query"] == {"energy": 0.8, "pitch": 0.85}
    assert got["unmatched"] == [("男声", "no-vocal-dimensions-in-library")] and [p[1] for p in got["proxies"]] == ["摇滚", "女声"]
    tagged = ft.tag_request("纯音乐 英文 摇滚", languages, genres, registers, {"language": 0, "genre": 5}, {"energy"})
    assert tagged["hard_filter"] == {"unflagged": True, "genre_is": "rock"} and tagged["unmatched"] == [("英文", "no-language-tag-in-library")]
    assert ft.residue("很治愈的高级感", []) == ["治愈", "高级感"] and ft.residue("来点爵士的歌，谢谢", []) == ["爵士"]


def test_requests_are_checked():
    assert catalogue.check_request({"event": "like", "track": 1}, {"event": ("like", "skip")}, ("track", "path")) == []
    assert catalogue.check_request({"event": "x"}, {"event": ("like",)}, ("track", "path")) == ["event: 'x'", "one of track, path"]


def test_vectors_of_one_length(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0])], "item_id bigint, vector array<double>")
    assert [r.item_id for r in catalogue.ordered_vectors(v).collect()] == [1, 2]
    with pytest.raises(ValueError):
        catalogue.ordered_vectors(v.unionByName(spark.createDataFrame([(3, [1.0])], "item_id bigint, vector array<double>")))


def test_tables_are_built_once_a_version(spark, tmp_path):
    built, source = [], str(tmp_path / "src")

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("y", F.col("id") * 2)

    spark.range(5).write.parquet(source)
    assert workspace.versioned(spark, "t", [source], build).count() == 5 and workspace.versioned(spark, "t", [source], build).count() == 5 and len(built) == 1
    spark.range(9).write.mode("append").parquet(source)
    assert workspace.versioned(spark, "t", [source], build).count() == 14 and len(built) == 2


def test_peaks_fall_back_to_the_greatest_value(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k bigint, i int, v double")
    assert [(r.at, r.value, r.prominence) for r in series.peaks(df, ["k"], "i", "v", 0.5, 2).collect()] == [(3, 4.0, 0.0)]


def test_model_is_kept_and_read_again(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((40, 6))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "item_id bigint, " + ", ".join(f"{c} double" for c in "abcdef"))
    model = discovery.PcaEmbedder(4).fit(df, list("abcdef"))
    model.to_table(spark).coalesce(1).write.parquet(str(tmp_path / "m"))
    back = discovery.PcaEmbedder.from_table(spark.read.parquet(str(tmp_path / "m")))
    one, two = ({r.item_id: r.vector for r in m.embed(df).collect()} for m in (model, back))
    assert all(np.allclose(one[i], two[i]) for i in one)
