"""Approximate nearest neighbours by learned partitions: a balanced partitioning of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._shared import release, settle, small_batches, sweep

NEIGHBOURS, QUERY_EVERY = 20, 20
#: Rows the partitions are learned from: so many for each partition, and at least. Rows a partition is planned for up to
#: CELLS[1] partitions; more rows make partitions larger, as one classifier must know them all. Fewest and most partitions.
SAMPLE, CELL_SAMPLE, CELL_ROWS, CELLS = 8192, 32, 200, (32, 2048)
#: Neighbours of a graph node; hidden units; share of a sample row's neighbours that routing must reach.
GRAPH, HIDDEN, AIM = 12, 128, 0.94
#: Candidates and queries that meet in one group, at most or so.
BLOCK, QUERIES = 2048, 512
#: Rows classified at a time; numbers of a product that the driver holds at a time, or so.
STRETCH, PRODUCT = 512, 1 << 20


@dataclass
class Router:
    """Weights of the classifier, and how many most probable partitions are searched."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray) -> np.ndarray:
        """The most probable partition of each row, a stretch of rows at a time."""
        parts = [np.argmax(self.logits(x[at : at + STRETCH]), axis=1) for at in range(0, len(x), STRETCH)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    out, x = [], x.astype(np.float32)
    rows = max(16, PRODUCT // len(x))  # small stretches: the driver's memory is not the executors'
    for at in range(0, len(x), rows):
        s = x[at : at + rows] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k].copy())  # a view would keep places of all rows
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    """Partition of the graph's nodes: grown from centres, then moves to the partition of most neighbours that has room."""
    x = x.astype(np.float32)
    centres = x[rng.choice(len(x), cells, replace=False)]
    rows = max(16, PRODUCT // cells)  # no table of rows x cells is made, which is 512 MB at the most partitions
    for _ in range(8):
        own = np.concatenate([np.argmax(x[at : at + rows] @ centres.T, axis=1) for at in range(0, len(x), rows)])
        for c in range(cells):
            if (own == c).any():
                m = x[own == c].mean(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    room = int(np.ceil(1.1 * len(x) / cells))
    label, size = np.full(len(x), -1), np.zeros(cells, int)
    nearest = np.concatenate([(x[at : at + rows] @ centres.T).max(axis=1) for at in range(0, len(x), rows)])
    order = np.argsort(-nearest)
    for at in range(0, len(x), rows):
        s = x[order[at : at + rows]] @ centres.T
        for i, near in zip(order[at : at + rows], s, strict=True):
            for c in np.argsort(-near):
                if size[c] < room:
                    label[i] = c
                    size[c] += 1
                    break
    for _ in range(6):
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[graph[i]], minlength=cells)
            votes[(size >= room) & (np.arange(cells) != label[i])] = -1
            to = int(np.argmax(votes))
            if votes[to] > votes[label[i]]:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
    return label


def fit(x: np.ndarray, cells: int, seed: int = 5) -> Router:
    """Learn partitions and router from sample rows x, which are all of what the driver holds."""
    rng = np.random.default_rng(seed)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    dim = x.shape[1]
    cells = max(1, min(cells, len(x) // 4))
    hidden = np.zeros((dim, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, cells)), np.zeros(cells)
    if cells == 1:
        return Router(*hidden, 1)
    graph = _graph(x, min(GRAPH, len(x) - 1))
    label = balanced_partition(x, graph, cells, rng)

    def soft(rows: np.ndarray) -> np.ndarray:
        """What the classifier is to say of rows: shares of their own partition and of their neighbours'."""
        out = np.zeros((len(rows), cells), np.float32)
        out[np.arange(len(rows)), label[rows]] = GRAPH / 2
        for j in range(graph.shape[1]):
            out[np.arange(len(rows)), label[graph[rows, j]]] += 1
        return out / out.sum(axis=1, keepdims=True)

    w = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), hidden[1], rng.standard_normal((HIDDEN, cells)) * np.sqrt(1 / HIDDEN), hidden[3]]
    first, second, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(30):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - soft(at)) / len(at)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for k, d in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] = w[k] - 3e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w, cells)
    near, own = _graph(x, min(NEIGHBOURS, len(x) - 1)), router.best(x)
    needed = np.zeros(near.shape, np.int32)  # place of a neighbour's partition among a row's most probable ones
    for at in range(0, len(x), STRETCH):
        z = router.logits(x[at : at + STRETCH])
        for j in range(near.shape[1]):
            needed[at : at + STRETCH, j] = (z > z[np.arange(len(z)), own[near[at : at + STRETCH, j]]][:, None]).sum(axis=1)
    router.probes = next((m for m in range(1, cells) if (needed < m).mean() >= AIM), cells)
    return router


def _rows(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _floors(x: np.ndarray, ids: np.ndarray, use: np.ndarray, known: np.ndarray, known_ids: np.ndarray, known_cells: np.ndarray, k: int) -> np.ndarray:
    """For each query of x the k-th best score among known candidates in the partitions it searches: no result is below."""
    out = np.full(len(x), -np.inf)
    if len(known) < k:
        return out
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ known.T
        s[~use[at : at + 256][:, known_cells] | (ids[at : at + 256, None] == known_ids)] = -np.inf
        out[at : at + 256] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return np.where(np.isfinite(out), out - 1e-9 * (1 + np.abs(out)), -np.inf)


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest found among vectors (vec_id, embedding) of each row of queries (the same columns), by inner product.

    query_id, rank, vec_id, score (the exact inner product in double precision), nearest first, ties to the smaller
    vec_id; a row of the query's own id is no candidate. Null and zero vectors, those with null or non-finite parts, and
    those whose length isn't the table's most frequent one take no part on either side. Every other row is indexed: it
    lies in the partition the router finds most probable, and groups of about BLOCK candidates are searched apart. Of
    equal vectors the k + 1 least ids are enough for any answer and are what is compared. A group passes on only what reaches
    the k-th best of the sample's rows in the query's partitions, below which no result lies. Repeated rows are candidates
    each; fewer than k candidates are all returned; without any there are no rows. The result's attribute `searched` says
    how many partitions are searched for a query, and of how many. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def usable(df: DataFrame, name: str) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        bad = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
        return df.select(F.col("vec_id").cast("bigint").alias(name), v.alias("v")).filter(F.col(name).isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda a: a != 0))

    all_ = usable(vectors, "vec_id")
    sizes = all_.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0][0]
    all_, asked = all_.filter(F.size("v") == dim), usable(queries, "query_id").filter(F.size("v") == dim)
    equal = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    fewer = settle(all_.withColumn("place", F.row_number().over(equal)).filter(F.col("place") <= k + 1))
    sweep(spark)
    firsts = fewer.filter("place = 1").select("vec_id", "v")
    rows = firsts.count()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003))
    cells = int(np.clip(2 ** round(np.log2(max(1, rows / CELL_ROWS))), *CELLS))
    most = max(SAMPLE, CELL_SAMPLE * cells)

    def some(df: DataFrame) -> pa.Table:
        """At most `most` rows, the same at any run."""
        few = df.filter(share < F.lit(1.2 * most / rows * 1_000_003))
        return few.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(most).toArrow()

    sample = some(firsts)
    known = _rows(sample if len(sample) else firsts.orderBy("vec_id").limit(1).toArrow())
    known = known[np.lexsort(known.T)]
    del sample
    sweep(spark)
    router = fit(known, cells)
    del known
    sweep(spark)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(router.best(_rows(b)) if b.num_rows else [], pa.int32())], ["vec_id", "v", "cell"])

    index = settle(fewer.select("vec_id", "v").mapInArrow(assign, "vec_id bigint, v array<double>, cell int"))
    release(fewer)
    sample = some(index)  # with the partitions that the index gave them: where a query searches, these rows are
    known, known_ids, known_cells = _rows(sample), sample.column("vec_id").to_numpy(), sample.column("cell").to_numpy()
    sweep(spark)
    held = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    count = np.array([held.get(c, 0) for c in range(len(router.b2))])

    # partitions stand in bundles of about BLOCK candidates, so that a query moves once for many small ones; a larger
    # partition is a bundle whose candidates lie in blocks
    bundle = np.zeros(len(count), np.int32)
    full = 0
    for c in range(1, len(count)):
        full += count[c - 1]
        bundle[c] = bundle[c - 1] if full + count[c] <= BLOCK else c
        full = full if bundle[c] == bundle[c - 1] else 0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, STRETCH) for whole in batches for at in range(0, whole.num_rows, STRETCH)):
            x = _rows(b)
            order = np.argsort(-router.logits(x), axis=1, kind="stable")
            reached = np.cumsum(count[order], axis=1) - count[order]  # candidates in more probable partitions
            use = (np.arange(order.shape[1]) < router.probes) | (reached <= 2 * k)
            searched = np.zeros(use.shape, bool)
            np.put_along_axis(searched, order, use, axis=1)
            searched &= count > 0
            floors = _floors(x, b.column(0).to_numpy(), searched, known, known_ids, known_cells, k)
            who, cells = np.nonzero(searched)
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (bundle[cells[1:]] != bundle[cells[:-1]]))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(cells)), pa.int32()), pa.array(cells, pa.int32()))
            asks = b.take(pa.array(who[new]))
            yield pa.RecordBatch.from_arrays([asks.column(0), asks.column(1), pa.array(floors[who[new]]), pa.array(bundle[cells[new]], pa.int32()), lists], ["query_id", "v", "least", "bundle", "cells"])

    routed = settle(asked.mapInArrow(route, "query_id bigint, v array<double>, least double, bundle int, cells array<int>"))
    asks = {r.bundle: r["count"] for r in routed.groupBy("bundle").count().collect()}
    sweep(spark)
    # a bundle's candidates lie in `b` blocks and its queries in `q`; each pair of blocks is a group
    many = {int(c): -(-int(count[bundle == c].sum()) // BLOCK) for c in set(bundle.tolist())}
    plan = spark.createDataFrame([(c, int(bundle[c]), max(1, many[int(bundle[c])]), -(-asks.get(int(bundle[c]), 0) // QUERIES)) for c in range(len(count))], "cell int, bundle int, b int, q int")
    by_bundle = plan.select("bundle", "b", "q").distinct()
    salt = lambda c, n: F.pmod(F.xxhash64(F.lit(3), c), F.col(n)).cast("int")
    left = index.join(F.broadcast(plan), "cell").filter("q > 0").select("bundle", salt("vec_id", "b").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), "vec_id", "v", "cell")
    right = routed.join(F.broadcast(by_bundle), "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("cb"), salt("query_id", "q").alias("qb"), "query_id", "v", "least", "cells")

    def rerank(cand: pa.Table, ask: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        if not len(cand) or not len(ask):
            return none
        q, ids, asked_ids, least = _rows(ask), *(t.column(n).to_numpy() for t, n in ((cand, "vec_id"), (ask, "query_id"), (ask, "least")))
        both, own = np.unique(np.concatenate((cand.column("cell").to_numpy()[:, None], _rows(cand)), axis=1), axis=0, return_inverse=True)
        own, cell, distinct = own.ravel(), both[:, 0], both[:, 1:]
        order = np.lexsort((ids, own))
        first = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
        groups = [g[: k + 1] for g in np.split(ids[order], first[1:])]  # equal vectors: the least ids come first
        lists = ask.column("cells").combine_chunks()
        whose = np.repeat(np.arange(len(ask)), lists.value_lengths().to_numpy())
        wanted = lists.flatten().to_numpy()
        rough = np.full((len(q), len(distinct)), -np.inf)
        for c in np.unique(cell):  # only queries that search a partition meet its candidates
            at, who = np.flatnonzero(cell == c), whose[wanted == c]
            rough[who[:, None], at] = q[who] @ distinct[at].T
        reach = min(k + 1, len(distinct))
        floor = -np.partition(-rough, reach - 1, axis=1)[:, reach - 1]
        floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.finfo(float).max)
        out = []
        for i, query in enumerate(asked_ids):
            at = np.flatnonzero(rough[i] >= max(least[i], floor[i]))
            if not len(at):
                continue
            exact = (distinct[at] * q[i]).sum(axis=1)
            who = np.concatenate([groups[j] for j in at])
            score = np.repeat(exact, [len(groups[j]) for j in at])
            who, score = who[keep := who != query], score[keep]
            best = np.lexsort((who, -score))[:k]
            out.append((np.full(len(best), query), who[best], score[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], none.column_names) if out else none

    key = ["bundle", "cb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out.searched = router.probes, len(count)  # partitions searched for a query, of how many
    return out


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))
