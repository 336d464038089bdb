"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._shared import BLANKS, settle, steps

WEIGHTS, SHARE, MAX_EPOCHS = (3.0, 1.0, 2.0), 1.5, 2
#: Output shards; least words of a block and most blocks in all; documents of a bucket of the prefix sums; seed.
SHARDS, BLOCK_WORDS, MAX_BLOCKS, BUCKET_DOCS, SEED = 16, 4096, 900_000_000, 1024, 42


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words to take of each source: shares by weight of SHARE of all words, each at most twice its source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))  # Python compares strings by code point
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    rest, open_, out = SHARE * sum(sizes.values()), set(names), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in names if s in open_ and unit * weight[s] > MAX_EPOCHS * sizes[s]]
        for s in over or open_:
            out[s] = float(MAX_EPOCHS * sizes[s]) if over else unit * weight[s]
        if not over:
            break
        rest -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def split_quotas(blocks: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) block quotas, drawn down a binary tree: each node's blocks are split between its halves
    as a draw without replacement would, so that all columns add up to `blocks` and shards are of one size."""
    out = np.zeros((shards, len(blocks)), np.int64)
    todo = [(0, shards, np.asarray(blocks, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, round(int(have.sum()) * (mid - lo) / (hi - lo)), method="marginals") if have.sum() else have * 0
        todo += [(lo, mid, draw), (mid, hi, have - draw)]
    return out


def _drawn(rows: DataFrame, small: DataFrame, shards: int, seed: int) -> DataFrame:
    """rows (id, source, size, and others) with source_size, target, taken and draws. small: the same ids, sources and sizes."""
    spark = rows.sparkSession
    found = small.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    size, count = ({r.source: r[c] for r in found} for c in ("size", "n"))
    goal = targets(size)
    block = max(BLOCK_WORDS, math.ceil(sum(size.values()) * SHARE / MAX_BLOCKS))
    take = {s: round(t) for s, t in goal.items()}
    names = sorted(size, key=lambda s: (s is None, s or ""))
    blocks = [math.ceil(take[s] / block) for s in names]
    ends = np.cumsum(split_quotas(blocks, shards, seed), axis=0)
    plan = []
    for i, s in enumerate(names):
        n = max(1, blocks[i])
        step = next(a for a in range(int(n * 0.618) + 1, 3 * n + 2) if math.gcd(a, n) == 1)
        plan.append((s, size[s], float(goal[s]), take[s], n, step, (seed * 7919 + i) % n, [int(x) for x in ends[:, i]], math.ceil(count[s] / BUCKET_DOCS)))
    by_source = spark.createDataFrame(plan, "name string, source_size bigint, target double, take bigint, blocks bigint, step bigint, shift bigint, ends array<bigint>, buckets bigint")
    key = F.xxhash64(F.lit(seed), F.col("id"))
    with_plan = lambda df: df.join(F.broadcast(by_source), df["source"].eqNullSafe(by_source["name"])).withColumn("bucket", F.pmod(key, "buckets"))
    up_to_now = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # words in a source's buckets before each, in two levels, so that no task sees all buckets of a source
    sums = with_plan(small.select("id", "source", "size")).groupBy("source", "bucket").agg(F.sum("size").alias("sum")).withColumn("over", F.expr(f"bucket div {BUCKET_DOCS}"))
    sums = settle(sums)
    over = sums.groupBy("source", "over").agg(F.sum("sum").alias("sum"))
    over = over.select(F.col("source").alias("s"), F.col("over").alias("o"), F.sum("sum").over(up_to_now(Window.partitionBy("source").orderBy("over"))).alias("far"))
    near = F.sum("sum").over(up_to_now(Window.partitionBy("source", "over").orderBy("bucket")))
    bases = sums.withColumn("near", near).join(over, sums["source"].eqNullSafe(over["s"]) & (sums["over"] == over["o"]))
    bases = settle(bases.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0))).alias("base")))
    inside = up_to_now(Window.partitionBy("source", "bucket").orderBy("order", "id", "size"))
    placed = with_plan(rows).withColumn("order", F.xxhash64(key, F.lit(1))).withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bases, placed["source"].eqNullSafe(bases["s"]) & (placed["bucket"] == bases["b"])).withColumn("at", F.col("at") + F.col("base"))

    def draw(i: int) -> Column:
        at = F.col("at") + i * F.col("source_size")
        number = F.expr(f"(at + {i} * source_size) div {block}")
        rank = F.pmod(number * F.col("step") + F.col("shift"), F.col("blocks"))
        shard = F.size(F.filter("ends", lambda e: e <= rank))
        got = F.when(shard < shards, F.greatest(F.lit(0), F.least(F.col("size"), F.col("take") - at))).otherwise(0)
        return F.struct(F.lit(i).alias("round"), got.alias("words"), shard.alias("shard"), number.alias("block"), F.xxhash64(F.lit(seed), F.lit(i), key).alias("place"))

    draws = F.filter(F.array(*(draw(i) for i in range(MAX_EPOCHS))), lambda d: d["words"] > 0)
    out = placed.withColumn("draws", draws).withColumn("taken", F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d["words"]))
    return out.select(*rows.columns, "source_size", "target", "taken", "draws")


def _named(docs: DataFrame) -> DataFrame:
    """Rows of docs as one column, so that no name of theirs can clash, beside what the mix reads of them."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with __size, __source_size, __target, __taken and __draws: what the mix takes of each row.

    docs needs doc_id, source and text; all its columns stay, but for any of these five names. A source's rows stand in
    an order given by a hash of doc_id, one or two rounds of them, cut into blocks of BLOCK_WORDS (a row belongs to the block
    it begins in). A source's quota is the number of blocks up to its target; the splitting tree says how many of them each
    shard gets, and an affine permutation of the block numbers which. A row is taken in the blocks that a shard has drawn; in
    the quota's last block the target cuts, so that only the row there is taken in part. __draws has, for each round that takes
    words of the row: round, words, shard, block (number within the source), place (sort key within the shard).

    Null source is a source of its own, the last; rows with null or empty text count 0 words and are taken 0 times; equal
    rows are separate rows; very long texts count whole; an empty table gives an empty result. The number of sources must
    be small enough for the driver, as they are named categories. From MAX_BLOCKS blocks on blocks are larger, as numpy
    draws exactly from fewer than 10^9.
    """
    rows = _named(docs)
    own = [F.col(c).alias(f"__{c}") for c in ("size", "source_size", "target", "taken", "draws")]
    names = {f"__{c}" for c in ("size", "source_size", "target", "taken", "draws")}
    return _drawn(rows, rows, shards, seed).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in names), *own)


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix as rows with the columns of docs, and __shard and __place (in place of columns so named): a row for each draw,
    its text cut after the drawn words at a target's end. Nulls, ties, repeated rows and empty tables as in `mix`."""
    rows = _named(docs)
    drawn = _drawn(rows, rows, shards, SEED).select("row", "size", F.explode("draws").alias("draw"))
    pieces = F.filter(F.split(F.col("row").getField("text"), f"[{BLANKS}]+"), lambda w: w != "")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") < F.col("size"), cut).otherwise(F.col("row").getField("text")).alias("text")
    columns = [text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("__shard", "__place")]
    return drawn.select(*columns, F.col("draw.shard").alias("__shard"), F.col("draw.place").alias("__place"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the mix, one folder per shard (column shard), each shuffled locally by its sort key; without rows an empty folder."""
    rows = mixed_documents(docs, shards)
    rows.repartition("__shard", F.pmod("__place", F.lit(64))).sortWithinPartitions("__shard", "__place").drop("__place").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with steps() as kept:
        sized = settle(docs.select(F.col("doc_id").alias("id"), "source", words(F.col("text")).alias("size")))
        kept.append(sized)
    got = _drawn(sized, sized, SHARDS, SEED)
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", *(F.col(f"draws.{c}").alias(c) for c in ("shard", "block", "place")))
