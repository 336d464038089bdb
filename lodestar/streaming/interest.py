"""Interest kept up to date by a stream, equal to the batch plan at any clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import interest

EVENT_SCHEMA = "event_id bigint, user_id bigint, item_id bigint, event string, epoch_s double, completion double"
#: Older events than the longest scope can't count any more.
KEEP = 2_592_000


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of interaction files as they arrive; events may come in any order."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_log(events: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append events to a log partitioned by day, so that scopes read their days only."""
    day = F.to_date(F.timestamp_seconds("epoch_s"))
    return events.withColumn("day", day).writeStream.partitionBy("day").format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_weights(spark: SparkSession, log: str, now: float) -> DataFrame:
    """Scope weights from the log; days outside the longest scope are pruned."""
    first = F.to_date(F.timestamp_seconds(F.lit(now - KEEP)))
    return interest.scope_weights(spark.read.parquet(log).filter(F.col("day") >= first), now)


def decayed_sums(events: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """user_id, item_id, event, bucket, mass: event weights decayed to their bucket's end.

    exp(-(now - end) / tau) * mass, summed over the buckets of a scope, is the interest at any later now; the state is
    one row per user, item, event and bucket rather than the events.
    """
    end = (F.floor(F.col("epoch_s") / bucket_seconds) + 1) * bucket_seconds
    tau = F.coalesce(*(F.when(F.col("event") == e, F.lit(t)) for e, (_, t) in interest.EVENTS.items()), F.lit(interest.OTHER_TAU))
    base = F.coalesce(*(F.when(F.col("event") == e, F.lit(b)) for e, (b, _) in interest.EVENTS.items()), F.lit(0.0))
    done = F.when((F.col("event") == "play") & F.col("completion").isNotNull(), F.col("completion")).otherwise(1.0)
    return events.groupBy("user_id", "item_id", "event", end.alias("bucket")).agg(F.sum(base * done * F.exp((F.col("epoch_s") - end) / tau)).alias("mass"))


def windowed_rates(events: DataFrame, window: str = "8 seconds", slide: str | None = "4 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling (slide None) or sliding counts and means of (ts, value); rows later than `late` are dropped by the watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
