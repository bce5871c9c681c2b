"""A table hashed into buckets by key, changed one commit at a time.

A commit writes the new content of the buckets it touches to a folder of its own and publishes a version whose
marker names every bucket's files, so readers see all of a commit or nothing, a crash leaves the version before it,
and untouched buckets keep their files.  The marker also names, for each source, the last batch applied: a batch that
is replayed is recognised, whichever sources write to the table.  Two writers that meet fail on the version's name,
and the one that loses replays its batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

APPLIED = sinks.NOTE + "applied/"


class Buckets:
    def __init__(self, spark: SparkSession, base: str, keys, count: int = 64):
        self.spark, self.base, self.count = spark, base.rstrip("/"), count
        self.keys = [keys] if isinstance(keys, str) else list(keys)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def state(self) -> tuple[int, dict[str, str]]:
        """The last version's number (-1: none) and its marker."""
        names = sinks.versions(self.spark, self.base)
        return (int(names[-1]), sinks.published(self.spark, self.base, names[-1])) if names else (-1, {})

    def applied(self, source: str, batch: int) -> bool:
        """Whether this batch of the source, or a later one, is part of the table."""
        last = self.state()[1].get(APPLIED + source)
        return last is not None and int(last) >= batch

    def touched(self, df: DataFrame) -> list[str]:
        """The buckets of df's keys: ``count`` names at most."""
        return [str(r["_b"]) for r in df.select(self.bucket().alias("_b")).distinct().collect()]

    def read(self, buckets: list[str] | None = None) -> DataFrame | None:
        """The whole table or some of its buckets; None where these hold nothing."""
        parts = self.state()[1]
        paths = [p for b, p in sorted(parts.items()) if not b.startswith(sinks.NOTE) and (buckets is None or b in buckets)]
        return self.spark.read.parquet(*paths) if paths else None

    def replace(self, rows: DataFrame, buckets: list[str], source: str = "load", batch: int = 0,
                notes: dict[str, str] | None = None) -> str:
        """Commit ``rows`` as the new content of ``buckets`` (all rows must hash into them), with notes for the
        marker.  Returns the version."""
        number, old = self.state()
        version = f"{number + 1:020d}"
        path = f"{self.base}/v={version}-{uuid.uuid4().hex[:8]}"  # what a failed attempt left is never read
        new = dict(old)
        if buckets:
            rows.withColumn("_b", self.bucket()).repartition("_b").write.partitionBy("_b").parquet(path)
            for b in buckets:
                fs, p = sinks._fs(self.spark, f"{path}/_b={b}")
                if fs.exists(p):
                    new[b] = f"{path}/_b={b}"
                else:
                    new.pop(b, None)  # no row is left in it
        sinks.publish(self.spark, self.base, version, new | (notes or {}) | {APPLIED + source: str(batch)})
        return version

    def load(self, rows: DataFrame) -> str:
        """Commit ``rows`` as the whole table."""
        return self.replace(rows, [str(b) for b in range(self.count)])
