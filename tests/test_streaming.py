import datetime as dt
import os

import pytest

from orderflow.sources import sinks
from orderflow.operators import analytics as A
from orderflow.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)


def run_to_table(df, base, mode="append"):
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    else:
        def w(b, i):
            b.write.mode("overwrite").parquet(f"{base}/out")
        q = df.writeStream.outputMode(mode).foreachBatch(w).option("checkpointLocation", f"{base}/ck") \
            .trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_weekly_equals_batch(spark, scratch):
    rows = [(dt.datetime(2024, 3, 1) + dt.timedelta(hours=9 * i), ["Latte", "Tea"][i % 2], "Hot",
             ["Oat", ""][i % 2], ["A , B", "B"][i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "archived_at timestamp_ntz, drink string, temperature string, "
                                     "milk string, syrups string")
    df.write.parquet(f"{scratch}/arch")
    stream = spark.readStream.schema(df.schema).parquet(f"{scratch}/arch")
    run_to_table(ST.stream_weekly_counts(stream), f"{scratch}/wk", mode="complete")
    got = sorted(tuple(r) for r in ST.weekly_top_from_counts(spark.read.parquet(f"{scratch}/wk/out"))
                 .select("week_start", "dim", "rnk", "item", "cnt").collect())
    want = sorted(tuple(r) for r in A.weekly_top_long(df).select("week_start", "dim", "rnk", "item", "cnt").collect())
    assert got == want


def test_stream_upsert_replay_safe(spark, scratch):
    rows = [("e1", "s1", T0, 1, "o1"), ("e1", "s2", T0 + dt.timedelta(days=1), 2, "o2"),
            ("e2", "s3", T0, 3, "o3")]
    df = spark.createDataFrame(rows, "endpoint string, id string, created_at timestamp_ntz, seq long, order_id string")
    df.write.parquet(f"{scratch}/subs")
    stream = spark.readStream.schema(df.schema).parquet(f"{scratch}/subs")
    q = ST.stream_upsert(stream, f"{scratch}/snap", "endpoint", ["created_at", "seq"], f"{scratch}/ck",
                         keep_first=("id", "created_at"))
    q.awaitTermination()
    snap = {r.endpoint: (r.id, r.order_id) for r in sinks.read_current(spark, f"{scratch}/snap").collect()}
    assert snap == {"e1": ("s1", "o2"), "e2": ("s3", "o3")}
    assert sinks.versions(spark, f"{scratch}/snap") == [f"{0:020d}"]


def test_stream_upsert_fails_rather_than_lose_rows(spark, scratch):
    schema = "endpoint string, id string, created_at timestamp_ntz, seq long"

    def feed(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(schema).parquet(f"{scratch}/in")
        ST.stream_upsert(stream, f"{scratch}/snap", "endpoint", ["created_at", "seq"], f"{scratch}/ck", buckets=2).awaitTermination()
    feed(1, [("a", "1", T0, 1), ("b", "2", T0, 2)])
    feed(2, [("c", "3", T0, 3), ("a", "0", T0 - dt.timedelta(days=1), 4)])     # a's update is late
    got = {r.endpoint: r.id for r in sinks.read_current(spark, f"{scratch}/snap").collect()}
    assert got == {"a": "1", "b": "2", "c": "3"}
    marker = f"{scratch}/snap/_versions/{1:020d}"
    whole = open(marker).read()
    with open(marker, "w") as f:                                               # damaged between two batches
        f.write(whole[:5])
    if os.path.exists(f"{scratch}/snap/_versions/.{1:020d}.crc"):
        os.remove(f"{scratch}/snap/_versions/.{1:020d}.crc")
    with pytest.raises(Exception):
        feed(3, [("d", "4", T0, 5)])
    with open(marker, "w") as f:
        f.write(whole)
    feed(4, [("e", "5", T0, 6)])
    got = {r.endpoint: r.id for r in sinks.read_current(spark, f"{scratch}/snap").collect()}
    assert got == {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1), (2, 1, 0), (1, 2, 0)])
def test_stream_upsert_gives_the_batch_result_in_any_batch_order(spark, scratch, order):
    schema = "endpoint string, id string, created_at timestamp_ntz, updated_at timestamp_ntz, seq long, order_id string"
    parts = [[("e1", f"s{k}", T0 + k * dt.timedelta(days=1), T0 + k * dt.timedelta(days=1), k, f"o{k}"),
              ("e2", f"t{k}", T0, T0, 0, f"p{k}"),                      # equal order keys
              (f"only{k}", "x", T0, T0, k, None)] for k in range(3)]
    rows = [r for p in parts for r in p]
    for k in order:
        spark.createDataFrame(parts[k], schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(schema).parquet(f"{scratch}/in")
        ST.stream_upsert(stream, f"{scratch}/snap", "endpoint", ["updated_at", "seq"], f"{scratch}/ck",
                         keep_first=("id", "created_at"), buckets=3).awaitTermination()
    got = {r.endpoint: tuple(r) for r in ST.current_rows(spark, f"{scratch}/snap").select(*schema.replace(",", "").split()[::2]).collect()}
    assert got["e1"] == ("e1", "s0", T0, T0 + 2 * dt.timedelta(days=1), 2, "o2") and len(got) == 5
    from orderflow.operators.upsert import merge_registers, registers
    whole = merge_registers(registers(spark.createDataFrame(rows, schema), "endpoint", ["updated_at", "seq"]), "endpoint", ("id", "created_at"))
    assert got == {r.endpoint: tuple(r) for r in whole.drop("_first_at", "_last_at").collect()}
