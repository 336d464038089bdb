"""What the operators share: the shared work folder, materialised steps, skew-safe lookups, span finding."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here, as a class body for Java's regular expressions.
BLANKS = r"\x20\x09-\x0D"


@functools.cache
def _own_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="lodestar-")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. In local mode a folder of our own will do if it is
    unset; executors elsewhere could not read that, so there it must be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (shared or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


_open: list[list[DataFrame]] = []


#: Bytes of a batch that goes to Python, in place of Spark's 64 MB: long texts then take the memory that short ones do.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's limit on a batch's bytes to BATCH_BYTES, unless it has one of its own."""
    if spark.conf.get(BATCH) in ("67108864", "67108864b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if _open:
        _open[-1].append(out)
    return out


@contextlib.contextmanager
def steps() -> Iterator[list[DataFrame]]:
    """What is settled within goes at the end, but for the frames put in the list it gives, which the result still reads."""
    mine, kept = [], []
    _open.append(mine)
    try:
        yield kept
    finally:
        _open.pop()
        release(*(df for df in mine if all(df is not k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now: it acts on what the driver's JVM has collected. The
    driver's Python gives back what it has freed, too."""
    trim()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete settled steps that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df._settled_at)


#: Bits of a filter, at most: 16 MB.
FILTER_BITS = 1 << 27


def maybe_in(rows: DataFrame, ids: DataFrame, key: str, room: int = 16) -> DataFrame:
    """rows with the column `maybe`: whether key is in ids, or looks so. False is certain, null keys give null.

    A bitmap of hashes, of `room` bits for an id and FILTER_BITS bits at most, is broadcast; so rows that are surely not
    asked for need not be shuffled. More ids than that make more rows look asked for, which only costs time.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (room * ids.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = ids.select(at(key).alias("h")).groupBy(F.expr("h div 32768").alias("__part")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("__bits"))
    own = rows.withColumn("__at", at(key)).join(F.broadcast(marks), F.expr("__at div 32768") == F.col("__part"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__at % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0, F.lit(False))
    return own.select(*rows.columns, F.when(F.col(key).isNotNull(), marked).alias("maybe"))


def slices(batch: pa.RecordBatch, column: int, most_rows: int = 1000, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """batch in stretches of at most so many rows and bytes of a string or binary column (a longer row alone)."""
    at, texts = 0, batch.column(column)
    ends = np.cumsum(_lengths(texts))
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def trim() -> None:
    """Give back to the system what this process has freed: workers are used again by later stages, and so is the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join left to right, unique on key. Both are settled tables (or narrow reads of such), so each gets a shuffle of
    its own and adaptive execution can split the rows of a hot key among tasks; an aggregate below would forbid that."""
    return left.join(right.hint("merge"), key, how)


def spans_of(text: Column, pattern: str, accept, gate: Column | None = None, context: int = 0) -> Column:
    """All leftmost non-overlapping matches that accept(value) keeps, as structs (start, end, value, near).

    Code points, end exclusive. near: up to `context` code points that precede the match, back to the match
    before it, a line break, and as many that follow the match, whatever they belong to. The pieces between matches
    and the matches themselves, both in order, give the positions.
    """
    struct = "array<struct<start:bigint,end:bigint,value:string,near:string>>"
    empty = F.array().cast(struct)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["v"])
        sides = F.substring(x["p"], -context, context), F.substring(text, (end + 1).cast("int"), F.lit(context))
        near = F.concat(sides[0], F.lit("\n"), sides[1]) if context else F.lit("")
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), near.alias("near")))
        return F.struct(end.alias("pos"), F.when(accept(x["v"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(pieces, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), lambda x: x["v"].isNotNull())
    first = F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out"))
    found = F.aggregate(pairs, first, step, lambda acc: acc["out"])
    return F.when(gate, found).otherwise(empty) if gate is not None else found


def joined(spans: Column) -> Column:
    """kind:start:end of spans with fields start, place (order of the kind), kind and end, by start, then place."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
