"""A table in buckets of time, with retention as a commit.

Rows lie in a folder for each UTC day of their time (and one for rows without a time).  A version's marker names the
days' folders.  Retention publishes a marker without the days that are wholly expired, rewrites the one day that the
limit cuts, and leaves every other folder as it is; where nothing is expired it publishes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

NO_DAY = "none"


class TimeBuckets:
    def __init__(self, spark: SparkSession, base: str, col: str = "created_at"):
        self.spark, self.base, self.col = spark, base.rstrip("/"), col

    def state(self) -> tuple[int, dict[str, str]]:
        names = sinks.versions(self.spark, self.base)
        return (int(names[-1]), sinks.published(self.spark, self.base, names[-1])) if names else (-1, {})

    def read(self) -> DataFrame | None:
        parts = self.state()[1]
        return self.spark.read.parquet(*sorted(parts.values())) if parts else None

    def _write(self, rows: DataFrame, number: int) -> dict[str, str]:
        """Write rows by day; a hot day is cut into several files by its times.  Returns day -> folder."""
        path = f"{self.base}/v={number}-{uuid.uuid4().hex[:8]}"
        day = F.coalesce(F.date_format(self.col, "yyyy-MM-dd"), F.lit(NO_DAY))
        rows.withColumn("_day", day).repartitionByRange("_day", self.col).write.partitionBy("_day").parquet(path)
        fs, p = sinks._fs(self.spark, path)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return {n[len("_day="):]: f"{path}/{n}" for n in names if n.startswith("_day=")}

    def load(self, rows: DataFrame) -> None:
        """Publish ``rows`` as the whole table."""
        number = self.state()[0] + 1
        sinks.publish(self.spark, self.base, f"{number:020d}", self._write(rows, number))

    def retain(self, limit: dt.datetime) -> int:
        """Drop the rows older than ``limit``; a null time stays.  Returns how many went."""
        number, parts = self.state()
        today = limit.date().isoformat()
        old = [d for d in parts if d != NO_DAY and d < today]
        gone = self.spark.read.parquet(*[parts[d] for d in old]).count() if old else 0
        new = {d: p for d, p in parts.items() if d not in old}
        if today in parts:
            rows = self.spark.read.parquet(parts[today])
            expired = F.coalesce(F.col(self.col) < F.lit(limit), F.lit(False))
            cut = rows.filter(expired).count()
            if cut:
                gone += cut
                del new[today]
                new |= self._write(rows.filter(~expired), number + 1)
        if gone:
            sinks.publish(self.spark, self.base, f"{number + 1:020d}", new)
        return gone
