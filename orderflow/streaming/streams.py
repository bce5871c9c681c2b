"""Structured Streaming twins of the batch operators.

The source application polls and diffs snapshots; here the same rules run
on change streams.  State is bounded: the weekly counts close a week once
the watermark passes its end, and an upsert keeps one row per key in a
bucketed table.  The change streams of orders (R2-R6) are in ledgers.py.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import expr as X
from ..operators import analytics as A
from ..operators.upsert import merge_registers, registers
from ..sources import schemas as S
from ..sources import sinks
from ..sources.buckets import Buckets


@contextlib.contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Size the state of a stream being started: the number of state
    partitions is fixed when a query first starts (it is kept in its
    checkpoint), from spark.sql.shuffle.partitions.  Defaults to the
    session's task slots; the session setting is restored afterwards.
    Start the query inside the ``with`` block."""
    key = "spark.sql.shuffle.partitions"
    prev = spark.conf.get(key)
    spark.conf.set(key, str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, prev)


def stream_changes(spark: SparkSession, path: str, schema: T.StructType = S.STATUS_CHANGES,
                   fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A change stream over files landing under ``path``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def announce_batch(batch: DataFrame) -> DataFrame:
    """The newest change of a micro-batch; R4's rule, by creation time among
    orders never announced, is ``ledgers.stream_ready_orders``."""
    return batch.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(1)


def stream_notify(ready: DataFrame, subs: DataFrame) -> DataFrame:
    """Stream-static join of ready events with current subscriptions,
    one payload per subscription."""
    j = ready.select("order_id").join(subs, "order_id", "inner")
    return j.select(*subs.columns, X.ready_message(F.col("customer_name"), F.col("order_name"),
                                                   F.col("order_id")).alias("payload"))


def stream_weekly_counts(df: DataFrame, tz: str = K.SHOP_TZ, time_col: str = "archived_at",
                         watermark: str = "2 hours") -> DataFrame:
    """Weekly (dim, item) counts on a stream.  The window runs on the
    local wall clock (so DST weeks are still Monday to Monday); the epoch
    day is a Thursday, so a 4-day start offset aligns windows to Mondays.
    The watermark exceeds the repeated autumn hour.  Rank at read time with
    ``weekly_top_from_counts``."""
    local = X.local_time(time_col, tz).cast("timestamp")
    base = A.clean_base(df.withColumn("_local", local), keep=("_local",))
    ex = A.unpivot(base.withWatermark("_local", watermark), ("_local",))
    g = ex.groupBy(F.window("_local", "7 days", "7 days", "4 days").alias("w"), "dim", "item").agg(
        F.count(F.lit(1)).alias("cnt"))
    start = X.from_local(F.col("w.start").cast("timestamp_ntz"), tz)
    return g.select(start.alias("week_start"), "dim", "item", "cnt")


def weekly_top_from_counts(counts: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """Top-k per (week, dim) from the streamed counts (batch read)."""
    summed = counts.groupBy("week_start", "dim", "item").agg(F.sum("cnt").cast("long").alias("cnt"))
    return A.top_items(summed, ("week_start",), k)


def stream_upsert(df: DataFrame, base: str, keys, order_by, checkpoint: str, keep_first=(),
                  trigger: dict | None = None, buckets: int = 64, source: str = "upsert"):
    """Keep the last state per key in a parquet snapshot, hashed into
    ``buckets`` by key.  The snapshot keeps, per key, the order key of its
    first and of its last values, and merging takes the least and the
    greatest of them: batches that arrive in any order give what one batch
    gives.  A micro-batch rewrites only the buckets it touches and a
    replayed batch id is a no-op (``sources.buckets``).  Only a proven
    absence of versions means "no snapshot yet"; any other failure stops
    the stream.  Read it with ``current_rows``."""
    spark = df.sparkSession
    table = Buckets(spark, base, keys, buckets)

    def write(batch: DataFrame, batch_id: int):
        if table.applied(source, batch_id):
            return
        b = merge_registers(registers(batch, keys, order_by), keys, keep_first).persist()
        try:
            touched = table.touched(b)
            old = table.read(touched)
            both = old.unionByName(b, allowMissingColumns=True) if old is not None else b
            table.replace(merge_registers(both, keys, keep_first), touched, source, batch_id)
        finally:
            b.unpersist()

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    with state_partitions(spark):
        return w.start()


def current_rows(spark: SparkSession, base: str) -> DataFrame:
    """The rows of a snapshot that ``stream_upsert`` keeps."""
    return sinks.read_current(spark, base).drop("_first_at", "_last_at")


# R7 under its survey name
stream_weekly = stream_weekly_counts
