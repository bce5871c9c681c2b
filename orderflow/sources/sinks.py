"""Sinks (S7, S8).

Appends are partitioned by date so later range filters prune directories.
A snapshot is written to a new version directory and only then published by
a marker of its own that is never changed (readers take the greatest), so
readers never see a half-written snapshot or none -- the all-or-nothing save
of the source.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, time_col: str = "created_at", fmt: str = "parquet",
           partitions: int | None = None, grain: str = "day") -> None:
    """Append rows, partitioned by the UTC date of ``time_col``.

    Rows are range-partitioned on (date, time) first, so each task writes a
    contiguous run of dates (files ~ tasks + dates, not tasks x dates) and
    a date holding a large share of the rows is still split across tasks."""
    day = F.to_date(F.col(time_col))
    d = df.withColumn("dt", day if grain == "day" else F.trunc(day, grain))
    # without an explicit count, AQE merges small adjacent ranges
    r = d.repartitionByRange(int(partitions), "dt", time_col) if partitions else d.repartitionByRange("dt", time_col)
    r.write.mode("append").partitionBy("dt").format(fmt).save(path)


NOTE = "#"  # a marker's entries under this prefix are notes, not paths


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, base: str) -> list[str]:
    """Names of the published versions, oldest first.  Only a folder that is
    proven absent means none; any other failure to list it is raised."""
    fs, folder = _fs(spark, f"{base.rstrip('/')}/_versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def publish(spark: SparkSession, base: str, version: str, parts: dict[str, str]) -> None:
    """Publish a version whose data is complete: its marker (part -> path) is
    written aside and renamed into place, and no marker is ever changed."""
    fs, folder = _fs(spark, f"{base.rstrip('/')}/_versions")
    jvm = spark.sparkContext._jvm
    fs.mkdirs(folder)
    aside = jvm.org.apache.hadoop.fs.Path(folder, f".{version}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    if not fs.rename(aside, jvm.org.apache.hadoop.fs.Path(folder, version)):
        raise FileExistsError(f"version {version} of {base} is published already")


def published(spark: SparkSession, base: str, version: str) -> dict[str, str]:
    """part -> path of a published version; read by the driver, no job runs."""
    fs, p = _fs(spark, f"{base.rstrip('/')}/_versions/{version}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def replace_snapshot(df: DataFrame, base: str, version: str | None = None) -> str:
    """Write a whole new version, then publish its marker.  Returns the
    version path."""
    version = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{base.rstrip('/')}/v={version}"
    if version in versions(df.sparkSession, base):
        raise FileExistsError(f"version {version} of {base} is published already")
    df.write.mode("overwrite").parquet(path)  # what an attempt that failed has left
    publish(df.sparkSession, base, version, {"all": path})
    return path


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """Read the greatest published version."""
    names = versions(spark, base)
    if not names:
        raise FileNotFoundError(f"no published version of {base}")
    parts = published(spark, base, names[-1])
    return spark.read.parquet(*sorted({path for part, path in parts.items() if not part.startswith(NOTE)}))


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Write a table bucketed and sorted on ``key`` (for example the order
    ledger and its status changes, both on order id).  Two tables bucketed
    the same way join on that key with no shuffle of either side.  ``path``
    makes it an external table at that (shared) location."""
    w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
