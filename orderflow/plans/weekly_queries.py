"""Registered queries of stored and streamed weekly counts and of quarantined rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators.weekly_rollup import WeeklyRollup
from ..sources import quarantine as QR
from ..sources import schemas as S
from ..streaming import streams as ST
from ..streaming.weekly import WeeklyStream
from . import adapters as V
from .io_queries import _scratch
from .registry import _render_summary, register

APPENDED = dt.datetime(1996, 7, 1)
DELETED = (dt.datetime(1995, 2, 1), dt.datetime(1995, 3, 20))
STREAMED = (dt.datetime(1995, 1, 1), dt.datetime(1997, 1, 1))
LATE_BEFORE = dt.datetime(1996, 1, 1)


@register("weekly_rollup")
def weekly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Stored counts of the archive appended in two parts, one of them sent twice, then seven weeks
    deleted; the trend from the counts, empty weeks included."""
    a, at = V.archive(spark, sf), F.col("archived_at")
    r = WeeklyRollup(spark, _scratch(spark, "rollup"))
    r.change(added=a.filter(at < F.lit(APPENDED)), batch=0)
    for _ in range(2):
        r.change(added=a.filter(at >= F.lit(APPENDED)), batch=1)
    r.change(removed=a.filter((at >= F.lit(DELETED[0])) & (at < F.lit(DELETED[1]))), source="clear")
    return _render_summary(r.trend(), ("week_start", "week_end"))


@register("stream_weekly_closed")
def stream_weekly_closed(spark: SparkSession, sf: str) -> DataFrame:
    """The archive in four batches by time, the last one of rows long late; counts of closed and open weeks, and the
    late rows by week."""
    a, at, base = V.archive(spark, sf), F.col("archived_at"), _scratch(spark, "weeks")
    late = (F.element_at(F.split("id", "-"), 2) == "7") & (at < F.lit(LATE_BEFORE))
    cuts = [at < F.lit(STREAMED[0]), (at >= F.lit(STREAMED[0])) & (at < F.lit(STREAMED[1])), at >= F.lit(STREAMED[1])]
    w = WeeklyStream(spark, f"{base}/weekly")
    for part in [*[c & ~late for c in cuts], late]:
        a.filter(part).write.mode("append").parquet(f"{base}/in")
        w.start(ST.stream_changes(spark, f"{base}/in", a.schema), f"{base}/ck").awaitTermination()
    kept = [c.withColumn("state", F.lit(n)) for n, c in (("closed", w.closed()), ("open", w.open()))]
    gone = (w.late().select(X.week_start("archived_at").alias("week_start")).groupBy("week_start").agg(F.count(F.lit(1)).alias("cnt"))
             .withColumn("dim", F.lit("total")).withColumn("item", F.lit("*")).withColumn("state", F.lit("late")))
    return kept[0].unionByName(kept[1]).unionByName(gone).select("state", "week_start", "dim", "item", "cnt")


def _broken_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue rows as JSON lines, some of them cut, blank, without an item, or with a wrong order or flag."""
    p, n = V.table(spark, sf, "part"), F.col("p_partkey")
    name = F.concat(F.lit('"item":"'), F.col("p_name"), F.lit('"'))
    row = lambda item, flag, order: F.concat(F.lit('{"id":"'), n.cast("string"), F.lit('",'), item, F.lit(',"available":'), flag, F.lit(',"sort_order":'), order, F.lit("}"))
    good = row(name, F.lit("true"), F.col("p_size").cast("string"))
    line = (F.when(n % 11 == 0, F.substring(good, 1, 20)).when(n % 13 == 0, F.lit("   "))
             .when(n % 17 == 0, row(F.lit('"item":null'), F.lit("false"), F.lit("1")))
             .when(n % 19 == 0, row(name, F.lit("true"), F.lit('"first"')))
             .when(n % 23 == 0, row(name, F.lit('"maybe"'), F.lit("2"))).otherwise(good))
    return p.select(line.alias("value"))


@register("quarantined_rows")
def quarantined_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue lines read by the declared schema, by batch and by stream; rows that fit and rows that don't."""
    base = _scratch(spark, "quarantine")
    _broken_catalogue(spark, sf).write.text(f"{base}/in")
    lines = QR.checked(spark.read.text(f"{base}/in"), S.INVENTORY, required=("id", "item"))
    both = [QR.good(lines).select(F.lit("good").alias("kind"), F.lit("").alias("reason"), "id", "item", "available", "sort_order"),
            QR.bad(lines).select(F.lit("bad").alias("kind"), "reason", *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("item", "string"), ("available", "boolean"), ("sort_order", "int"))])]
    QR.stream_checked(spark.readStream.text(f"{base}/in"), S.INVENTORY, f"{base}/out", f"{base}/ck", required=("id", "item")).awaitTermination()
    streamed = [spark.read.parquet(f"{base}/out/good").select("id", "item", "available", "sort_order"), spark.read.parquet(f"{base}/out/bad").select("reason")]
    cols = ["kind", "reason", "item", "available", "sort_order"]
    live = (streamed[0].select(F.lit("good").alias("kind"), F.lit("").alias("reason"), "id", "item", "available", "sort_order")
            .unionByName(streamed[1].select(F.lit("bad").alias("kind"), "reason"), allowMissingColumns=True))
    count = lambda df, how: df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).withColumn("how", F.lit(how))
    return count(both[0].unionByName(both[1]), "batch").unionByName(count(live, "stream")).select("how", *cols, "rows")
