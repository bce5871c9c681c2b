"""The weekly trend from stored counts (G8 with S15, Q15 and G6).

The table holds one row per (local week, dim, item) with its count, in buckets by week.  Counts add up, so appended
orders add theirs and deleted orders take theirs back; a change rewrites only the buckets of the weeks it touches and is
published by one marker that names it, so a repeated change does nothing and a crash leaves the counts before it.  The
trend reads the counts alone, however large the archive is.

Defined cases: an item whose count falls to zero leaves the table, and so does a week without orders, which the report
still shows with zeros between the first and the last week; taking back orders that were never added is an error and
publishes nothing; orders without a time are counted in no week of the report; empty input changes no count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.buckets import Buckets
from . import analytics as A

KEYS = ("week_start", "dim", "item")


class WeeklyRollup:
    def __init__(self, spark: SparkSession, base: str, tz: str = K.SHOP_TZ, time_col: str = "archived_at", buckets: int = 64):
        self.table, self.tz, self.time_col = Buckets(spark, base, "week_start", buckets), tz, time_col

    def _counts(self, orders: DataFrame, sign: int) -> DataFrame:
        c = A.weekly_counts(orders, (), self.tz, self.time_col)
        return c.withColumn("cnt", (F.col("cnt") * sign).cast("long"))

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, source: str = "load", batch: int = 0) -> bool:
        """Count ``added`` orders and take ``removed`` ones back in one commit; False if this batch of the source was
        already applied."""
        if self.table.applied(source, batch):
            return False
        parts = [self._counts(df, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
        if not parts:
            return False
        delta = _summed(reduce(DataFrame.unionByName, parts)).persist()
        try:
            touched = self.table.touched(delta)
            old = self.table.read(touched)
            rows = _summed(old.select(*delta.columns).unionByName(delta)) if old is not None else delta
            short = F.raise_error(F.lit("orders taken back that were never counted")).cast("long")
            rows = rows.withColumn("cnt", F.when(F.col("cnt") > 0, F.col("cnt")).otherwise(short))
            self.table.replace(rows, touched, source, batch)
        finally:
            delta.unpersist()
        return True

    def counts(self) -> DataFrame | None:
        """(week_start, dim, item, cnt), None before the first change."""
        rows = self.table.read()
        return rows.select(*KEYS, "cnt") if rows is not None else None

    def trend(self, k: int = K.TOP_K) -> DataFrame | None:
        """The weekly trend, empty weeks included."""
        rows = self.counts()
        return A.with_empty_weeks(A.trend_of(rows, (), k, self.tz), self.tz) if rows is not None else None


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEYS).agg(F.sum("cnt").cast("long").alias("cnt")).filter(F.col("cnt") != 0)
