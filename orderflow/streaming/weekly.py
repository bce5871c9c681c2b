"""Weekly counts of an archive stream whose weeks close (R7 in append mode, with the late rows set aside).

The open weeks' counts lie in a bucketed table.  A micro-batch adds its rows, moves the watermark to the newest time
seen less ``delay``, and closes every week that ended by then: its counts are appended to the closed output and leave
the state.  A row whose week has closed is not counted but written to the late output as it is, so counted and late
rows always sum to the input.  A batch writes its outputs to folders named by its id and publishes last, by the
state's marker, which holds the watermark and the batch id: readers see published batches only, a replayed batch
writes the same rows again or does nothing, and an executor lost in between costs a retry.

A batch's rows are read twice, for the late ones and for the counts, and only counts are held in memory, so the source
must give a batch's rows again, as files do.

Defined cases: rows without a time are late rows; an empty batch closes nothing; weeks are local, so those with a
clock change are 167 or 169 hours long.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from ..operators import analytics as A
from ..sources import sinks
from ..sources.buckets import APPLIED, Buckets

WATERMARK = sinks.NOTE + "watermark"
COUNTS = ("week_start", "dim", "item")


class WeeklyStream:
    def __init__(self, spark: SparkSession, base: str, delay: dt.timedelta = dt.timedelta(hours=2), tz: str = K.SHOP_TZ,
                 time_col: str = "archived_at", buckets: int = 16):
        self.spark, self.base, self.delay, self.tz, self.time_col = spark, base.rstrip("/"), delay, tz, time_col
        self.state = Buckets(spark, f"{self.base}/open", COUNTS, buckets)

    def watermark(self) -> dt.datetime | None:
        text = self.state.state()[1].get(WATERMARK)
        return dt.datetime.fromisoformat(text) if text else None

    def _ended(self, limit: dt.datetime | None):
        """Whether the row's week ended by ``limit``."""
        if limit is None:
            return F.lit(False)
        local = X.local_time("week_start", self.tz)
        return X.from_local(F.timestamp_add("WEEK", F.lit(1), local), self.tz) <= F.lit(limit)

    def _batch(self, batch: DataFrame, number: int) -> None:
        if self.state.applied("weekly", number):
            return
        before, time = self.watermark(), F.col(self.time_col)
        late = time.isNull()
        if before is not None:  # a week has ended by the watermark if it lies before the watermark's own week
            late = late | (time < F.lit(A.week_bounds(before, 0, self.tz)[0]))
        batch.filter(late).write.mode("overwrite").parquet(f"{self.base}/late/batch={number}")
        dated = batch.filter(~late).withColumn("week_start", X.week_start(self.time_col, self.tz))
        base = A.clean_base(dated.withColumn("_time", time), keep=("week_start", "_time"))
        added = A.unpivot(base, ("week_start", "_time")).groupBy(*COUNTS).agg(F.count(F.lit(1)).alias("cnt"), F.max("_time").alias("_newest")).persist()
        try:
            # late rows lie before the watermark, so the newest row counted moves it
            newest = added.agg(F.max("_newest").cast("timestamp_ntz").alias("t")).first()["t"]
            seen = [t for t in (before, newest - self.delay if newest else None) if t]
            after = max(seen) if seen else None
            rows, old = added.drop("_newest"), self.state.read()
            if old is not None:
                rows = rows.unionByName(old.select(*rows.columns)).groupBy(*COUNTS).agg(F.sum("cnt").cast("long").alias("cnt"))
            rows = rows.persist()
            try:
                rows.filter(self._ended(after)).write.mode("overwrite").parquet(f"{self.base}/closed/batch={number}")
                notes = {WATERMARK: after.isoformat()} if after else {}
                self.state.replace(rows.filter(~self._ended(after)), [str(b) for b in range(self.state.count)], "weekly", number, notes)
            finally:
                rows.unpersist()
        finally:
            added.unpersist()

    def start(self, df: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Run the stream ``df`` of archive rows; returns the streaming query."""
        w = df.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"availableNow": True})).start()

    def _published(self, output: str) -> DataFrame | None:
        last = self.state.state()[1].get(APPLIED + "weekly")
        if last is None:
            return None
        return self.spark.read.parquet(f"{self.base}/{output}").filter(F.col("batch") <= int(last)).drop("batch")

    def closed(self) -> DataFrame | None:
        """Final counts of the closed weeks (week_start, dim, item, cnt); each appears once."""
        return self._published("closed")

    def open(self) -> DataFrame | None:
        """Counts so far of the weeks that are still open."""
        rows = self.state.read()
        return rows.select(*COUNTS, "cnt") if rows is not None else None

    def late(self) -> DataFrame | None:
        """The rows that came after their week had closed, as they came."""
        return self._published("late")
