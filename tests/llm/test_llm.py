"""The other operators against brute force, round trips and held-out accuracy, on a small fixture with odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, jaccard_join, langid, mixing, neighbours, packing, quality, url_filter

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, token string, label int, a bigint"
ODD = [None, "", " \n ", "a", "A b\tc D", "a B c d", "one two three four five", "!!! 123", "x " * 30_000, "y" * 200_000, "<|endoftext|> a  b   c\n\n d", "é ü ß 𝒳 " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(200_000 + i, t, None if i % 2 else "en", None if i % 3 else "zz", None, 1, "t", 0, 2) for i, t in enumerate(ODD)], SCHEMA)
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).cast("bigint").alias("node"), F.lit("t").alias("token"), F.lit(0).alias("label"), F.lit(2).cast("bigint").alias("a"))
    return odd.unionByName(real).unionByName(odd.limit(5)).cache()


def word_set(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    sets = {d: word_set(t) for d, t in rows}
    nodes, root = list({s for s in sets.values() if s}), {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    index = defaultdict(list)
    for i, s in enumerate(nodes):
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                common[j] += 1
            index[x].append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(nodes[j]) - c) and find(i) != find(j):
                root[find(i)] = find(j)
    at, least = {s: i for i, s in enumerate(nodes)}, {}
    for d, s in sets.items():
        if s:
            least[find(at[s])] = min(least.get(find(at[s]), d), d)
    return {d: (len(s), least[find(at[s])] if s else d) for d, s in sets.items()}


def test_jaccard_join(spark, docs):
    got = jaccard_join.join(docs).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count() and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_join_second_step(spark):
    """A chain and a crowd of near copies that are partly apart, in lists longer than the first step covers."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            w[j] = f"z{i}-{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:9] + [f"u{i}-{k}" for k in range(4)])) for i in range(100)]
    want = brute_components(rows)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got) and len(got) == 250


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_language(spark, docs):
    profiles = langid.train(docs.filter(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(docs, profiles).withColumn("held_out", langid.held_out()).collect()}
    truth = {r.doc_id: r.lang for r in docs.filter("doc_id < 200000").collect()}
    held = [d for d in truth if got[d].held_out]
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == got[d].held_out for d in got)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[200_000 + i].lang_pred == "und" for i in (0, 1, 2, 7))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), {}).collect()} == {"und"} and langid.predict(docs.limit(0), profiles).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.standard_normal((600, 8)), np.repeat(rng.standard_normal((1, 8)), 700, axis=0)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] + [1.0] * 7), (5060, [None] + [1.0] * 7), (5080, [1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(v, v.filter("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        mine = sorted(got[q])
        assert len(mine) == 20 and [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits, total = hits + len({m[1] for m in mine} & set(want.tolist())), total + 20
    assert set(got) == set(range(0, len(x), 20)) and hits / total >= 0.9
    few = neighbours.search(v.limit(4), v.limit(4)).collect()
    assert len(few) == 12 and neighbours.search(v.limit(0), v).count() == 0


def test_neighbours_recall_on_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = v.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    got = neighbours.search(v, v.filter("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    at = {d: i for i, d in enumerate(ids)}
    recall = [len(set(r.v) & set(ids[np.argsort(-np.where(ids == r.query_id, -9, x @ x[at[r.query_id]]))[:20]])) / 20 for r in got]
    assert np.mean(recall) >= 0.9


def test_mixing(spark, docs):
    got = mixing.mix(docs).select("doc_id", "source", "__size", "__source_size", "__target", "__taken", "__draws").collect()
    assert len(got) == docs.count()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r["__size"]
        taken[r.source] += r["__taken"]
        target[r.source] = r["__target"]
        assert 0 <= r["__taken"] <= 2 * r["__size"] and r["__taken"] == sum(d.words for d in r["__draws"])
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] for s in size)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3 * sum(size.values())
    assert {(r.doc_id, r["__taken"]) for r in mixing.mix(docs.repartition(7)).collect()} == {(r.doc_id, r["__taken"]) for r in got}
    rows = mixing.mixed_documents(docs)
    assert rows.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())
    quotas = mixing.split_quotas([50, 7, 0, 900], 8)
    assert quotas.sum(axis=0).tolist() == [50, 7, 0, 900] and quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 2
    assert mixing.targets({"a": 100, "b": 100, None: 0}) == {"a": 200.0, "b": 100.0, None: 0.0}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_returns_the_tree(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), 100).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op5_mixing(spark, str(tmp_path)).collect()
    take = {s: round(t) for s, t in mixing.targets({f"s{i}": 100_000 for i in range(3)}).items()}
    want = mixing.split_quotas([-(-take[f"s{i}"] // mixing.BLOCK_WORDS) for i in range(3)], mixing.SHARDS)
    blocks, at = defaultdict(set), {}
    for r in got:
        assert len(r.shard) == len(r.block) == len(r.place) == -(-r.taken // 100)
        for shard, block in zip(r.shard, r.block, strict=True):
            blocks[shard, r.doc_id % 3].add(block)
            assert at.setdefault((r.doc_id % 3, block), shard) == shard
    assert [[len(blocks[k, i]) for i in range(3)] for k in range(mixing.SHARDS)] == want.tolist()
    import corpus_pipeline

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = [r.doc_id for r in sorted(mixing.mixed_documents(docs).collect(), key=lambda r: (r["__shard"], r["__place"]))]
    assert [r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, str(tmp_path)).collect()] == order


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = quality.train(big, labels.filter("doc_id % 2 = 0"))
    got = quality.score(big, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select(F.avg((F.col("accepted") == (F.col("quality") == 1)).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("accepted").cast("int")))).first()
    assert got[0] > 0.95 and got[1] > 0.97
    assert quality.score(docs, model).count() == docs.count() and quality.accepted(docs, model).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None and quality.accepted(docs, None).count() == docs.count() and quality.score(docs.limit(0), model).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs, with_ids=True).toPandas()
    full = packing.encoder("byte_bpe_50k").full
    per = defaultdict(list)
    for r in docs.collect():
        per[r.doc_id].append([*full.encode(r.text or "", add_special_tokens=False).ids, 1])
    for r in got.itertuples():
        ids = per[r.doc_id][0]
        assert r.doc_tokens == len(ids) and list(r.ids) == ids[r.start : r.start + r.length] and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
    lengths = got.groupby("doc_id").length.sum()
    assert all(lengths[d] == sum(map(len, x)) for d, x in per.items())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert (n := s.length.sum()) <= 2048 and n & (n - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3)) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_url_filter(spark):
    entries = [("host", "A.example", "add", "2024-01-10"), ("host", "a.example", "add", "2024-01-12"), ("host", "a.example", "remove", "2024-01-20"), ("domain", "example.org", "add", "2024-02-01"), ("domain", "b.org", "add", "2024-03-01"), ("domain", "b.org", "remove", "2024-03-01"), (None, "x", "add", "2024-01-01"), ("host", None, "add", None)]
    cases = [("http://a.example/x", "2024-01-09", 0), ("http://u@A.EXAMPLE:80/x", "2024-01-10", 1), ("https://a.example.", "2024-01-19", 1), ("http://a.example", "2024-01-20", 0), ("http://sub.example.org/", "2024-02-01", 1), ("http://notexample.org/", "2024-03-01", 0), ("http://b.org", "2024-03-02", 0), (None, "2024-02-02", 0), ("nonsense", "2024-02-02", 0), ("http://example.org", None, 0)]
    e = spark.createDataFrame(entries, "kind string, value string, action string, day string").withColumn("day", F.col("day").cast("date"))
    c = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id bigint, url string, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.page_id: r.n_active for r in url_filter.judge(c.unionByName(c.limit(2)), e).collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(cases)} and url_filter.judge(c.limit(0), e).count() == 0


def test_queries_with_sql_and_pipeline(spark):
    import corpus_pipeline
    from lodestar.llm import queries
    from tests.oracle import compare

    for name, sql in queries.ORACLE_SQL.items():
        compare(spark, name, queries.QUERIES[name], sql, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.cache()
        kept[name] = docs.count()
    ids = [r.doc_id for r in docs.collect()]
    assert kept["quality classifier"] >= kept["exact dedup"] >= kept["n-gram Jaccard join"] and max(map(ids.count, set(ids))) <= 2
    assert corpus_pipeline.run(spark, SF).select(F.sum("length")).first()[0] > 0


def test_quality_learns_from_the_whole_pool(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    few = labels.filter("doc_id % 4 = 0")
    model = quality.train(docs, few)
    assert model.pool == docs.join(few.filter("quality in (0, 1)"), "doc_id", "left_anti").count() > 8000
    assert all(g > 0.2 * model.pool for g in model.given), model.given
    # the distributed fit against one in memory, on the same rows
    rows = docs.select(*quality.COLUMNS).toPandas().sort_values("doc_id")
    y = rows.doc_id.map(few.toPandas().groupby("doc_id").quality.min()).to_numpy(float)
    counts, meta = quality._features([rows[c].tolist() for c in quality.COLUMNS[1:]])
    x = quality.text_view(counts), meta
    free = np.isnan(y)
    taught = quality.taught(tuple(v[free] for v in x), model.rounds)
    fit = np.flatnonzero(~free)[np.arange((~free).sum()) % 4 != 3]
    for k in (0, 1):
        at = np.flatnonzero(free)[taught[k] >= 0]
        a = quality._with_one(np.concatenate((x[k][fit], x[k][at])))
        t, weight = np.concatenate((y[fit], taught[k][taught[k] >= 0])), np.concatenate((np.ones(len(fit)), np.full(len(at), quality.PSEUDO * min(1, quality.LABELLED / model.pool))))
        p = 1 / (1 + np.exp(-a @ model.views[k]))
        penalty = 1e-3 * (len(fit) + min(1, quality.LABELLED / model.pool) * len(at))
        assert len(at) == model.given[k] and np.abs(a.T @ (weight * (p - t)) + penalty * model.views[k]).max() < 0.05
