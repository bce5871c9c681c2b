"""Registered queries for the scalar functions (F1-F22, J4, U2, W3) and the
stream twins (R1-R3, R5, R7, R9), each over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from ..operators import analytics as A
from ..operators import ranking as R
from ..session import checkpoint_dir
from ..streaming import streams as ST
from . import adapters as V
from .registry import register


@register("order_texts")
def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    """F11-F14, F16 (label and progress), F17, F21, W3 over the ranked queue."""
    q = R.fifo_position(V.queue(spark, sf))
    name = F.replace(F.col("customer_name"), F.lit("#"), F.lit(" "))
    pos = F.col("position")
    given = F.when(pos % 2 == 0, pos)
    return q.select(
        "id",
        X.age_text("created_at", F.lit(V.QUEUE_AS_OF)).alias("age"),
        X.ticket_no(pos).alias("ticket"),
        X.wait_text(pos).alias("wait"),
        X.wait_minutes(pos).cast("long").alias("wait_minutes"),
        X.ahead_text(pos).alias("ahead"),
        X.status_label("status").alias("label"),
        X.first_name(name).alias("first_name"),
        X.word_count(name).cast("long").alias("words"),
        X.position_or(given, X.orders_ahead(pos)).cast("long").alias("position_fixed"),
        X.progress("status")["making"].alias("step_making"),
        X.progress("status")["ready"].alias("step_ready"))


@register("catalogue_texts")
def catalogue_texts(spark: SparkSession, sf: str) -> DataFrame:
    """F1, F2, F5, F6, F10 over part."""
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    flags = F.array(F.lit("on"), F.lit(" Yes"), F.lit("0"), F.lit("OFF"), F.lit("bad"), F.lit(None).cast("string"))
    flag = F.element_at(flags, (F.col("p_size") % 6 + 1).cast("int"))
    raw = F.concat(F.lit(" "), F.col("p_brand"), F.lit("!"))
    return p.select(
        "p_partkey",
        X.slug("p_name").alias("slug"),
        X.slug(raw).alias("slug_client"),
        X.slug(raw, strip=False).alias("slug_sql"),
        X.unquote(F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).alias("unquoted"),
        X.clip("p_name", 5).alias("clipped"),
        X.bool_text(flag, True).alias("flag"),
        X.default_blank(F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.col("p_brand")), F.lit("Milk"))
         .alias("milk"))


@register("list_texts")
def list_texts(spark: SparkSession, sf: str) -> DataFrame:
    """F3, F4, F15, F20, J4, U2 over part."""
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    syr_text = F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.replace("p_name", F.lit(" "), F.lit(" , ")))
    words = F.split("p_name", " ")
    temps = (F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Cold"), F.lit("Hot"), F.lit("Cold")))
             .when(F.col("p_size") % 3 == 1, F.array(F.lit("Warm"))).otherwise(F.array(F.lit("Cold"))))
    milk = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_brand"))
    allowed = F.array(F.lit("red"), F.lit("small"), F.lit("blue"), F.lit("new"))
    return p.select(
        "p_partkey",
        X.list_text(X.text_list(syr_text)).alias("syrups_text"),
        F.size(X.text_list(syr_text)).cast("long").alias("n_items"),
        X.order_summary(F.lit("Hot"), F.col("p_type"), milk, words).alias("summary"),
        F.array_join(X.cap_list(words, allowed, 1), ",").alias("capped"),
        F.array_join(X.whitelist(temps), ",").alias("temps"),
        F.array_join(X.distinct_list(temps), ",").alias("distinct_temps"))


@register("week_texts")
def week_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every local week of the archive with its label and range."""
    a = V.archive(spark, sf).select(X.week_start("archived_at").alias("week_start")).distinct()
    cur = A.week_bounds(V.ARCHIVE_AS_OF, 0)[0]
    n = (F.datediff(F.to_date(X.local_time("week_start")), F.to_date(X.local_time(F.lit(cur)))) / 7).cast("long")
    end = X.week_start("week_start", n=1)
    return a.select("week_start", end.alias("week_end"), n.alias("offset"), X.week_label(n).alias("label"),
                    X.week_range("week_start", end).alias("range_text"))


@register("json_texts")
def json_texts(spark: SparkSession, sf: str) -> DataFrame:
    """JSON member access and rows as JSON text."""
    e = V.table(spark, sf, "events").select("event_id", "event_type", "props")
    return e.select("event_id", X.jget("props", "k").alias("k"),
                    X.row_json(["event_id", "event_type"]).alias("row_json"))


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a file stream (the file source, one
    file here, any number in production)."""
    sch = V.table(spark, sf, "events").schema
    return (spark.readStream.schema(sch).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf))


def _run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to completion (availableNow) into a parquet table under
    the checkpoint folder and read the table back."""
    import uuid
    base = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    with ST.state_partitions(df.sparkSession):
        if mode == "append":
            q = (df.writeStream.format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
        else:
            def write(batch, batch_id):
                batch.write.mode("overwrite").parquet(f"{base}/out")
            q = (df.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{base}/out")


@register("stream_weekly_top")
def stream_weekly_top(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly counts on the line-item stream joined to static parts,
    ranked at read time."""
    li_sch = V.table(spark, sf, "lineitem").schema
    li = (spark.readStream.schema(li_sch).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
          .select("l_partkey", "l_shipdate", "l_linestatus"))
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    arch = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_shipdate").alias("archived_at"), F.col("p_type").alias("drink"),
        F.when(F.col("l_linestatus") == "F", F.lit("Hot")).otherwise(F.lit("COLD")).alias("temperature"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("milk"),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")))
         .alias("syrups"))
    counts = _run(ST.stream_weekly_counts(arch), "weekly", mode="complete")
    return ST.weekly_top_from_counts(counts, K.TOP_K).select("week_start", "dim", "rnk", "item", "cnt")


@register("syrup_items")
def syrup_items(spark: SparkSession, sf: str) -> DataFrame:
    """The archive's syrup text split to one row per item, blanks dropped."""
    a = V.archive(spark, sf).select("id", X.blank_to_null("syrups").alias("syrups"))
    return A.explode_list(a, "syrups", "syrup").select("id", "syrup")
