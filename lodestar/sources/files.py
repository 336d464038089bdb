"""Directory scans, incremental state and content identity over the binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = 262_144


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".mp3", ".wav"), recursive: bool = True, content: bool = False) -> DataFrame:
    """path, size, mtime (and content) of the files below root whose names end in one of suffixes, in any case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes])
    return df.filter(ends).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


def content_id(content: Column, size: Column) -> Column:
    """16 hex digits of SHA-1 over a version mark with the size, the first 256 KiB and, beyond 512 KiB, the last 256 KiB."""
    head = F.substring(content, F.lit(1), F.lit(EDGE))
    tail = F.when(size > 2 * EDGE, F.substring(content, F.length(content) - EDGE + 1, F.lit(EDGE))).otherwise(F.lit(b""))
    return F.substring(F.sha1(F.concat(F.concat(F.lit("v2:"), size.cast("string")).cast("binary"), head, tail)), 1, 16)


def scan_status(listing: DataFrame, state: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Status of each listed row (path, size, mtime) against state (path, size, mtime, analysis_version):
    new, changed, stale (same file, other version) or same; `todo` says whether it must be analysed."""
    old = state.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("analysis_version").alias("old_version"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    status = F.when(F.col("old_size").isNull() | F.col("old_mtime").isNull(), "new").when(~same, "changed").when(F.col("old_version").eqNullSafe(F.lit(version)), "same").otherwise("stale")
    return listing.join(old, "path", "left").select("path", "size", "mtime", status.alias("status"), (F.lit(force) | (status != "same")).alias("todo"))


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Projection that leaves out columns df lacks."""
    return df.select([c for c in columns if c in df.columns])
