"""Archive moves as one commit.

The queue and its archive are published together: a version's marker names the queue's files and every part of the
archive.  A move writes the remaining queue and the archived rows aside and publishes both by one new marker, so
whatever step fails, readers see the queue and the archive of before, and after it those of the move; no order is in
both or in neither.  Archive parts are only added, so their files never move.  A move's name is kept in the marker:
the same move again is a no-op.  Two moves that meet fail on the version's name, and the loser is tried again.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from .archive import archive_split
from .filters import is_open

DONE = sinks.NOTE + "move/"


class ShopLedger:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _state(self) -> tuple[int, dict[str, str]]:
        names = sinks.versions(self.spark, self.base)
        return (int(names[-1]), sinks.published(self.spark, self.base, names[-1])) if names else (-1, {})

    def _publish(self, number: int, parts: dict[str, str]) -> None:
        sinks.publish(self.spark, self.base, f"{number:020d}", parts)

    def _aside(self, df: DataFrame, name: str, number: int) -> str:
        path = f"{self.base}/{name}/v={number}-{uuid.uuid4().hex[:8]}"  # what a failed move left is never read
        df.write.parquet(path)
        return path

    def load(self, orders: DataFrame) -> None:
        """Publish ``orders`` as the queue; the archive stays."""
        number, parts = self._state()
        self._publish(number + 1, parts | {"queue": self._aside(orders, "queue", number + 1)})

    def read(self) -> tuple[DataFrame, DataFrame | None]:
        """(queue, archive) of one version; no archive before the first move."""
        parts = self._state()[1]
        old = [p for k, p in sorted(parts.items()) if k.startswith("archive/")]
        return self.spark.read.parquet(parts["queue"]), (self.spark.read.parquet(*old) if old else None)

    def move(self, cond: Column, as_of: dt.datetime, name: str) -> bool:
        """Archive the orders that satisfy ``cond`` (null: stay) at ``as_of``.  Whether anything was published."""
        number, parts = self._state()
        if DONE + name in parts:
            return False
        archived, remaining = archive_split(self.spark.read.parquet(parts["queue"]), cond, as_of)
        number += 1
        rest = self._aside(remaining, "queue", number)
        gone = self._aside(archived, "archive", number)
        self._publish(number, parts | {"queue": rest, f"archive/{number:020d}": gone, DONE + name: as_of.isoformat()})
        return True

    def clear_completed(self, as_of: dt.datetime) -> bool:
        """Q12: archive the complete orders."""
        return self.move(F.col("status") == "complete", as_of, f"completed/{as_of.isoformat()}")

    def clear_all(self, settings: DataFrame, as_of: dt.datetime) -> bool:
        """Q13/V3: archive every order while the shop is closed; open, nothing is published."""
        if self.spark.range(1).select(is_open(settings).alias("open")).first()["open"]:
            return False
        return self.move(F.lit(True), as_of, f"all/{as_of.isoformat()}")
