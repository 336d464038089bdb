"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._shared import BLANKS, delete, lookup, maybe_in, settle, steps, work_dir

#: Files of a bucket, on the average, from which an index is written anew.
COMPACT_AT = 8


def digest(text: Column) -> Column:
    """SHA-256 of the text, null as empty, with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " "), 256)


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest, so that anti-joins of new data read it unshuffled.

    With a name it lies in the shared folder under that name and is found there again by later sessions, whatever their
    catalog; without one it is scratch, to be dropped after use. Each batch appends a file to a bucket; from COMPACT_AT
    batches on the buckets are written anew as a next version, one sorted file each. Versions are complete before the table
    points to them. Only one writer at a time may add to an index.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.folder = f"{work_dir(spark)}/{self.name}"
        found = [p.rsplit("/", 1)[-1] for p in self._list(self.folder)]
        versions = sorted(tuple(map(int, re.fullmatch(r"v(\d+)-(\d+)", p).groups())) for p in found if re.fullmatch(r"v\d+-\d+", p) and self._list(f"{self.folder}/{p}/_SUCCESS"))
        self.version, self.buckets = versions[-1] if versions else (0, buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self._point()

    def _list(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [str(f.getPath()) for f in files.listStatus(at)] if files.exists(at) else []

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version}-{self.buckets}"

    def _create(self, table: str, version: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        columns = "(digest STRING, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest)"
        self.spark.sql(f"CREATE TABLE {table} {columns} INTO {self.buckets} BUCKETS LOCATION '{self._path(version)}'")

    def _append(self, df: DataFrame, table: str) -> None:
        """Add one file to each bucket that gets rows."""
        df.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(table)

    def _point(self) -> None:
        self._create(self.name, self.version)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append what the index lacks of groups (digest, keep_id), found by a sort-merge anti-join."""
        self._append(groups.select("digest", "keep_id").join(self.table().hint("merge"), "digest", "left_anti"), self.name)
        if len(self._list(self._path(self.version))) > COMPACT_AT * self.buckets:
            self.compact()

    def compact(self) -> None:
        """Write the next version, in which every bucket is one sorted file, and drop the one before."""
        old, new = self._path(self.version), f"{self.name}_next"
        self._create(new, self.version + 1)
        # under another expression: a repartition as the table is bucketed would be left out, and then its bucketed reading too
        self._append(self.table().select(F.concat("digest", F.lit("")).alias("digest"), "keep_id"), new)
        self.spark.sql(f"DROP TABLE {new}")
        self.version += 1
        self._point()
        delete(self.spark, old)

    def drop(self) -> None:
        """Delete the index. What `match` returned does not read it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.folder)


def match(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate docs (doc_id, text) as one batch against index, and append the batch's new digests.

    One row per input row: doc_id, digest, keep_id, group_size (equal rows of this batch), kept. Null text equals
    empty text. In a group new to the index the smallest doc_id stays, in a known one the row already indexed.
    Rows that repeat both doc_id and text are one document: kept is the same for each. Null ids stay
    only where a group has no other. An empty table gives an empty result; other columns are not read; very long texts
    are digested whole.
    """
    with steps() as kept:
        staged = settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest")))
        groups = settle(staged.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        index.add(groups)
        owners = settle(groups.select("digest", "group_size").join(index.table().hint("merge"), "digest"))
        kept += [staged, owners]
    return lookup(staged, owners, "digest").withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeating id and text one. See `match` for nulls and ties.

    A bitmap of the digests in groups of more than one row, or already indexed, tells which rows surely stay: they are
    neither shuffled nor sorted. The others meet the ids that stay by id and digest, so a large group is spread out.
    """
    with steps() as kept:
        matched = settle(match(docs, index))
        kept.append(matched)
    key = F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), digest(F.col("text")).alias("digest"))
    open_ = matched.filter("group_size > 1 or not kept").select("digest").distinct()
    rows = maybe_in(own, open_, "digest")
    stay = matched.filter("kept").select(F.col("doc_id").alias("id"), "digest").select(key, "digest")
    rest = rows.filter("maybe").select("row", key, "digest").dropDuplicates(["key", "digest"]).join(stay.hint("merge"), ["key", "digest"], "left_semi")
    return rows.filter("not maybe").select("row.*").unionByName(rest.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark)
    found = match(docs, index)
    index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
