"""Cases that each operator must get exactly right: built collisions, white space, clashing names, reopened stores, plain recounts."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import _shared, exact_dedup, jaccard_join, langid, mixing, neighbours, packing, quality, secrets, url_filter

ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id int, size int, maybe boolean, __size bigint, __shard int, __place int, stays int, key string, digest string, at int"
ODD = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", None, None, None), (2, "a b c d e f", None, None, None), (None, "x y", "en", "s", 3), (4, None, None, "t", 0), (5, "", "en", "t", 0), (6, "word " * 40_000, "de", "s", 200_000), (7, "  \n ", "fr", "u", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "r", 1, 2, True, 99, 3, 4, 5, "k", "d", 6) for r in ODD], ODD_SCHEMA)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_shingles_of_a_thue_morse_word_and_its_complement_differ(spark, n):
    word = thue_morse(n)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, f"{word} {word}")]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_shingle_sets_are_those_of_words():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [f"w{x}" for x in rng.integers(0, 6, int(rng.integers(0, 40)))]
        want = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        a, b = jaccard_join.shingles(" \t".join(words))
        assert len(a) == len(b) == len(want) and len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(want)
        other = jaccard_join.shingles(" ".join(words[::-1]))
        back = {tuple(words[::-1][i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words[::-1])} - {()}
        assert jaccard_join.in_common((a, b), other) == len(want & back)


def test_ids_of_texts_that_mix_white_space():
    rng, enc = np.random.default_rng(4), packing.encoder("byte_bpe_50k")
    marks = ["é", "x", " ", " ", " ", "　", "\n", "\t", "1", "'s", ",", "\x1c", " ", "\x85", " a", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks, int(rng.integers(0, 10)), p=[0.065] * 15 + [0.025])) for _ in range(20_000)] + ["    "]
    want = [enc.full.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint16).tolist() for x in enc.encode_batch(texts)] == want


def test_packing_takes_more_ranges_for_more_bytes(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 300).alias("text"))
    few = packing.pack(docs).select(F.expr("shiftright(sequence_id, 40)").alias("r")).distinct().count()
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    more = packing.pack(docs)
    assert few <= 4 < more.select(F.expr("shiftright(sequence_id, 40)").alias("r")).distinct().count()
    assert more.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).filter("not ok").count() == 0


def test_mixing_against_a_plain_recount(spark):
    """Every row's taken words, shard and block, from the splitting tree's quotas, in plain Python."""
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("case when id % 10 < 6 then 'hot' when id % 10 = 6 then null else concat('s', id % 10) end").alias("source"), F.repeat(F.lit("w "), (F.col("id") * 37 % 300).cast("int")).alias("text"))
    key = F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"))
    rows = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64(key, F.lit(1)).alias("order")).collect()
    size, count = Counter(), Counter(r.source for r in rows)
    for r in rows:
        size[r.source] += r.size
    goal, names = mixing.targets(dict(size)), sorted(size, key=lambda s: (s is None, s or ""))
    blocks = [math.ceil(round(goal[s]) / mixing.BLOCK_WORDS) for s in names]
    ends, want = np.cumsum(mixing.split_quotas(blocks, mixing.SHARDS), axis=0), {}
    for i, s in enumerate(names):
        own = sorted((r for r in rows if r.source == s), key=lambda r: (r.key % math.ceil(count[s] / mixing.BUCKET_DOCS), r.order, r.doc_id))
        step = next(a for a in range(int(blocks[i] * 0.618) + 1, 3 * blocks[i] + 2) if math.gcd(a, blocks[i]) == 1)
        at = 0
        for turn in range(2):
            for r in own:
                words = max(0, min(r.size, round(goal[s]) - at))
                if words:
                    rank = (at // mixing.BLOCK_WORDS * step + (mixing.SEED * 7919 + i) % blocks[i]) % blocks[i]
                    want.setdefault(r.doc_id, []).append((turn, words, int((ends[:, i] <= rank).sum()), at // mixing.BLOCK_WORDS))
                at += r.size
    got = {r.doc_id: [(d["round"], d.words, d.shard, d.block) for d in r["__draws"]] for r in mixing.mix(docs).collect()}
    assert {d: x for d, x in got.items() if x} == want and len(got) == n


def test_mixing_takes_what_the_tree_gives(spark, monkeypatch):
    """With a tree that hands out no block nothing is taken: the quotas decide, not the position alone."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), 50).alias("text"))
    monkeypatch.setattr(mixing, "split_quotas", lambda blocks, shards, seed: np.zeros((shards, len(blocks)), np.int64))
    assert mixing.mix(docs).agg(F.sum("__taken")).first()[0] == 0


def test_written_shards_are_the_mix(spark, tmp_path):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.repeat(F.lit("w "), 200).alias("text"))
    mixing.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("s")).collect()
    want = mixing.mixed_documents(docs).groupBy("__shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("s")).collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, want)) and len(back) > 1


def test_clashing_names_and_odd_rows(spark, odd):
    taken = {r.doc_id: (r["__size"], r["__taken"]) for r in mixing.mix(odd).collect()}
    assert taken[1][0] == 6 and taken[6][0] == 40_000 and taken[5] == (0, 0)
    assert [c for c in mixing.mixed_documents(odd).columns if not c.startswith("__")] == [c for c in odd.columns if not c.startswith("__")]
    index = exact_dedup.DigestIndex(spark)
    once = exact_dedup.deduplicate(odd, index)
    assert once.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == [(False, 1), (False, 4), (False, 6), (False, 7), (True, 0)]
    one = jaccard_join.one_of_each(odd)
    assert one.columns == odd.columns and Counter(r.doc_id for r in one.collect()) == Counter([1, None, 4, 5, 6, 7])
    assert quality.accepted(odd, None).count() == len(ODD) and packing.pack(odd).count() > len(ODD)
    empty = odd.limit(0)
    assert not any(f.count() for f in (mixing.mixed_documents(empty), exact_dedup.deduplicate(empty, index), jaccard_join.one_of_each(empty), quality.accepted(empty, None), packing.pack(empty)))
    index.drop()


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() > 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_index_is_found_again_and_compacted(spark, monkeypatch):
    name = "digests_of_test"
    batch = lambda *ids: spark.createDataFrame([(i, f"text {i % 100}") for i in ids], "doc_id bigint, text string")
    first = exact_dedup.DigestIndex(spark, name, buckets=3)
    assert exact_dedup.match(batch(1, 2, 3), first).filter("kept").count() == 3
    spark.sql(f"DROP TABLE {name}")  # what another session would see: files, but no table
    again = exact_dedup.DigestIndex(spark, name)
    assert again.buckets == 3 and {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.match(batch(102, 4), again).collect()} == {(102, 2, False), (4, 4, True)}
    monkeypatch.setattr(exact_dedup, "COMPACT_AT", 0)
    exact_dedup.match(batch(5, 105, 6), again)
    assert again.version == 1 and again.table().count() == 6 and sorted(r.keep_id for r in again.table().collect()) == [1, 2, 3, 4, 5, 6]
    files = [f for f in os.listdir(again._path(1)) if f.endswith(".parquet")]
    assert len(files) <= 3 and os.listdir(again.folder) == ["v1-3"]
    plan = batch(7).select(exact_dedup.digest(F.col("text")).alias("digest")).join(again.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    latest = exact_dedup.DigestIndex(spark, name)
    assert latest.version == 1 and exact_dedup.match(batch(206), latest).first().keep_id == 6
    latest.drop()
    assert not os.path.exists(latest.folder)


def test_steps_are_deleted(spark, odd):
    folder = _shared.work_dir(spark)
    before = set(os.listdir(folder))
    jaccard_join.join(odd).count()
    exact_dedup.match(odd, index := exact_dedup.DigestIndex(spark)).count()
    index.drop()
    left = set(os.listdir(folder)) - before
    assert len(left) <= 4, left


def test_bare_secrets_that_only_the_model_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model, at = secrets.learn(spark, docs)
    labelled = secrets.random_strings(spark, 9000).filter("length(token) >= 20").limit(3000).unionByName(secrets.identifiers(docs, 4000).filter("length(token) >= 20"))
    rates = {r.label: r.rate for r in labelled.groupBy("label").agg(F.avg((secrets.llr(F.col("token"), model) >= at).cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.98 and rates[0] < 0.001, rates
    texts = ["see Zk3Qp9XwTr5LmVb8Nc2HsYd7 there", "see the_value_of_parameter_12 there", "q8Wz-1Kd7_Pv3Rt6Yx9Lb2Mf", "getCustomerAddressLine2Again", None, ""]
    found = secrets.digest_columns(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, at), secrets.BASE)
    got = {r.doc_id: (r.spans, r.n_assign + r.n_access + r.n_hex, len(r.scores)) for r in found.collect()}
    assert got == {0: ("markov:4:28", 0, 1), 1: ("", 0, 0), 2: ("markov:0:24", 0, 1), 3: ("", 0, 0), 4: ("", 0, 0), 5: ("", 0, 0)}
    assert secrets.threshold(spark.createDataFrame([], "token string, label int"), model) == secrets.LLR_AT


def test_routing_prunes_where_vectors_have_structure(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = neighbours.search(v, v.filter("vec_id % 20 = 0"))
    probes, cells = got.searched
    by = defaultdict(set)
    for r in got.collect():
        by[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -9
        recall.append(len(by[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert cells >= 32 and probes <= cells / 4 and np.mean(recall) >= 0.9, (probes, cells, np.mean(recall))


def test_router_is_learned_in_bounded_memory():
    """The driver holds the sample and its lists of neighbours, no table of rows x rows or rows x partitions."""
    import tracemalloc

    x = np.random.default_rng(6).standard_normal((3000, 8))
    tracemalloc.start()
    try:
        graph = neighbours._graph(x, 12)
        lists = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        label = neighbours.balanced_partition(np.tile(x, (2, 1)), np.tile(graph, (2, 1)), 1500, np.random.default_rng(6))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    s = x @ x[:50].T
    s[np.arange(50), np.arange(50)] = -np.inf
    assert (np.sort(graph[:50]) == np.sort(np.argsort(-s.T)[:, :12])).all() and np.bincount(label).max() <= np.ceil(1.1 * 4)
    assert lists < 3e7 and peak < 2.5e7, (lists, peak)  # 72 MB and 36 MB or more, if tables stay


def test_routing_searches_a_part_of_the_table(spark):
    """On vectors without structure, too, whose recall another test measures."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    probes, cells = neighbours.search(v, v.filter("vec_id % 20 = 0")).searched
    assert cells == 32 and probes <= 0.8 * cells


def test_language_distance_against_plain_lists():
    """Rank-order profiles and the out-of-place distance, spelled out with strings and lists."""
    def profile(text, n):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        grams = Counter()
        for w in words:
            for k in (1, 2, 3):
                p = f" {w} " if k > 1 else w
                grams.update(p[i : i + k] for i in range(len(p) - k + 1))
        code = lambda g: sum((0 if c == " " else ord(c)) << (21 * (len(g) - 1 - j)) for j, c in enumerate(g)) + (0, langid.TWO, langid.THREE)[len(g) - 1]
        return [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:n]

    texts = {"en": "the cat and the dog went to the house and sat there", "de": "der hund und die katze sind im haus und schlafen dort"}
    known = {k: profile(t, langid.PROFILE) for k, t in texts.items()}
    longest = max(map(len, known.values()))
    ready = [(k, np.sort(np.array(p)), np.argsort(np.array(p))) for k, p in sorted(known.items())]
    for text in ("the house and the cat", "die katze und der hund", "Über-the haus", "a"):
        mine = profile(text, langid.DOC_PROFILE)
        codes, counts = langid.ngram_counts(text)
        assert langid.top(codes, counts, langid.DOC_PROFILE).tolist() == mine
        away = {k: sum(abs(p.index(g) - i) if g in p else longest for i, g in enumerate(mine)) / len(mine) / longest for k, p in known.items()}
        lang = min(sorted(away), key=lambda k: away[k])
        got = langid.identify(text, ready, longest)
        assert got[0] == lang and abs(got[1] - (1 - away[lang])) < 1e-12


def test_metadata_view_reads_no_text():
    a, b = (quality._features([["one text"], ["en"], ["s"], [8]]), quality._features([["ANOTHER!!\n| x"], ["en"], ["s"], [8]]))
    assert (a[1] == b[1]).all() and not (a[0] == b[0]).all()
    assert quality._features([[None], [None], [None], [None]])[1].sum() == 2


def test_url_filter_of_long_hosts_and_empty_lists(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 500 + "example/x", "2024-01-01"), (2, "http://b.example", "2024-01-01")], "page_id bigint, url string, day string").withColumn("day", F.col("day").cast("date"))
    entries = spark.createDataFrame([("domain", "example", "add", "2023-01-01")], "kind string, value string, action string, day string").withColumn("day", F.col("day").cast("date"))
    assert [r.blocked for r in url_filter.judge(pages, entries).collect()] == [True, True]
    assert not any(r.blocked for r in url_filter.judge(pages, entries.limit(0)).collect())


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError):
        _shared.work_dir(Elsewhere)
