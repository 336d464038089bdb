"""Tables kept by the version of what they were computed from, and products of blocks of rows."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="lodestar-core-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; in local mode a folder of our own will do if it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (shared or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listing.hasNext():
        f = listing.next()
        out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return sorted(out)


def versioned(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of these sources, built at the first call for their files' names, sizes and times, read afterwards.

    It is written elsewhere and then moved, so that a half-written one is never read.
    """
    version = hashlib.sha256(repr([_files(spark, s) for s in sources]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/table-{name}-{version}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop(path)):
        new = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(new)
        if not files.rename(hadoop(new), hadoop(path)) and not files.exists(hadoop(path)):
            raise OSError(f"could not move {new}")
    return spark.read.parquet(path)


def block_products(left: DataFrame, right: DataFrame, keys: tuple[str, str], run, schema: str, rows: tuple[int, int]) -> DataFrame:
    """run(left rows, right rows) of every pair of blocks, as Arrow tables; a block has about so many rows of either side.

    Rows go to blocks by a hash of their key; each side is sent once for every block of the other, and no side to the driver.
    """
    blocks = [max(1, -(-df.count() // n)) for df, n in zip((left, right), rows, strict=True)]
    own = lambda df, key, n: df.withColumn("__own", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    spread = lambda df, n: df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = spread(own(left, keys[0], blocks[0]), blocks[1]).withColumnsRenamed({"__own": "__a", "__other": "__b"})
    b = spread(own(right, keys[1], blocks[1]), blocks[0]).withColumnsRenamed({"__own": "__b", "__other": "__a"})
    a, b = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (a, b))  # both may come from one table
    return a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInArrow(run, schema)
