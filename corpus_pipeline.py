"""From documents to packed training sequences: reject, deduplicate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, jaccard_join, mixing, packing, quality
from lodestar.llm._shared import settle, steps


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, repeated rows each. Nulls count as values of their own; rows of equal
    views are judged alike; without labels of both classes all rows stay; an empty table stays empty."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text (null as empty) the one with the smallest doc_id, a null one only where there is no other;
    of rows that repeat both one. An empty table stays empty."""
    index = exact_dedup.DigestIndex(spark)
    kept = exact_dedup.deduplicate(docs, index)
    index.drop()
    return kept


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near-equal shingle sets the one with the smallest doc_id. Rows without doc_id or words
    are linked with nothing and stay; an empty table stays empty."""
    return jaccard_join.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, in the order of its shards and their places; a document drawn twice is two rows. A null source
    is one of its own; documents without words are not drawn; of an empty table nothing is."""
    rows = mixing.mixed_documents(docs)
    return rows.repartitionByRange("__shard", "__place").sortWithinPartitions("__shard", "__place").drop("__shard", "__place")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, along the space-filling curve, with their ids. Null and empty texts are the end id alone,
    a repeated row is packed again; an empty table gives no sequence."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("n-gram Jaccard join", near_deduplication),
    ("mixing sources", source_mixing),
    ("packing", sequence_packing),
]

#: A trained classifier and a tokenizer decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on documents, each written before the next reads it; what a stage alone has written goes after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with steps() as kept:
            docs = settle(stage(spark, docs, sf_dir))
            kept.append(docs)
