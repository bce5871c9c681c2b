import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import ranking as R
from orderflow.sources import schemas as S
from orderflow.sources.buckets import Buckets
from orderflow.streaming import ledgers as L

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)
KEYS = ("order_id", "ts", "seq", "status", "prev_status")


def made_up(n=220, orders=12, seed=1):
    """Changes of few orders (one of them hot), many with equal times."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"o{rng.randrange(orders)}", T0 + dt.timedelta(minutes=rng.randrange(60)), i,
             rng.choice(["waiting", "making", "ready", "complete", "complete"])) for i in range(n)]


def run(spark, base, parts, start):
    for rows in parts:
        spark.createDataFrame(rows, S.STATUS_CHANGES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        start(spark.readStream.schema(S.STATUS_CHANGES).parquet(f"{base}/in")).awaitTermination()


def edges(df):
    return sorted(tuple(str(r[k]) for k in KEYS) for r in df.collect())


def test_edges_equal_batch_for_any_file_order(spark, scratch):
    rows = made_up()
    random.Random(7).shuffle(rows)
    run(spark, scratch, [rows[i::3] for i in range(3)], lambda s: L.stream_edges(s, f"{scratch}/e", f"{scratch}/ck", buckets=4))
    assert edges(L.read_edges(spark, f"{scratch}/e")) == edges(R.ready_edges(spark.createDataFrame(rows, S.STATUS_CHANGES)))
    ops = {r.op for r in spark.read.parquet(f"{scratch}/e/edges").select("op").distinct().collect()}
    assert ops == {1, -1}      # late rows undid edges


def test_replayed_batch_changes_nothing(spark, scratch):
    rows, calls = made_up(60), []
    run(spark, scratch, [rows], lambda s: L.stream_edges(s, f"{scratch}/e", f"{scratch}/ck", on_batch=lambda c, i: calls.append(c.count())))
    before = edges(L.read_edges(spark, f"{scratch}/e"))
    stream = spark.readStream.schema(S.STATUS_CHANGES).parquet(f"{scratch}/in")
    L.stream_edges(stream, f"{scratch}/e", f"{scratch}/ck-lost", on_batch=lambda c, i: calls.append(c.count())).awaitTermination()
    assert len(calls) == 1 and edges(L.read_edges(spark, f"{scratch}/e")) == before


def test_lateness_bounds_the_state_and_counts_what_is_late(spark, scratch):
    parts = [[("o1", T0, 1, "waiting"), ("o1", T0 + DAY, 2, "making"), ("o2", T0, 3, "ready")],
             [("o1", T0 + 5 * DAY, 4, "complete"), ("o2", T0 + 5 * DAY, 5, "making")],
             [("o1", T0 + dt.timedelta(hours=1), 6, "ready"), ("o2", T0 + 4 * DAY, 7, "complete"), ("o2", T0 + 6 * DAY, 8, "complete")]]
    run(spark, scratch, parts, lambda s: L.stream_edges(s, f"{scratch}/e", f"{scratch}/ck", lateness=2 * DAY, buckets=2))
    assert [r.seq for r in L.read_late(spark, f"{scratch}/e").collect()] == [6]
    used = [r for p in parts for r in p if r[2] != 6]
    assert edges(L.read_edges(spark, f"{scratch}/e")) == edges(R.ready_edges(spark.createDataFrame(used, S.STATUS_CHANGES)))
    state = Buckets(spark, f"{scratch}/e/changes", "order_id", 2).read()
    assert sorted(r.seq for r in state.collect()) == [2, 3, 4, 5, 7, 8]      # one change of each order before the horizon


def test_forgotten_orders_fire_again(spark, scratch):
    parts = [[("o1", T0, 1, "ready"), ("o2", T0, 2, "waiting")], [("o1", T0 + dt.timedelta(hours=1), 3, "ready"), ("o2", T0 + 3 * DAY, 4, "waiting")],
             [("o1", T0 + 4 * DAY, 6, "complete")]]
    run(spark, f"{scratch}/a", parts, lambda s: L.stream_edges(s, f"{scratch}/a/e", f"{scratch}/a/ck", ttl=2 * DAY))
    assert [(r.order_id, r.seq, r.prev_status) for r in L.read_edges(spark, f"{scratch}/a/e").collect()] == [("o1", 6, None)]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_first_ready_and_announcements(spark, scratch, order):
    parts = [[("a", T0 + 3 * DAY, 3, "ready"), ("b", T0 + 3 * DAY, 4, "ready"), ("seed", T0, 0, "ready")],
             [("a", T0 + DAY, 1, "complete"), ("c", T0 + DAY, 2, "ready"), ("w", T0, 9, "waiting")],
             [("d", T0 + 4 * DAY, 5, "ready"), ("e", T0 + 4 * DAY, 6, "complete"), ("c", T0 + 5 * DAY, 7, "complete")]]
    made = spark.createDataFrame([("a", T0 + DAY), ("b", T0), ("c", T0), ("d", T0), ("e", T0)], "id string, created_at timestamp_ntz")
    seed = spark.createDataFrame([("seed",)], "order_id string")
    run(spark, scratch, [parts[i] for i in order], lambda s: L.stream_ready_orders(s, f"{scratch}/r", f"{scratch}/ck", orders=made, seeded=seed))
    rows = [r for p in parts for r in p if r[0] != "seed"]
    want = sorted(map(tuple, R.first_ready(spark.createDataFrame(rows, S.STATUS_CHANGES)).select("order_id", "ts", "seq", "status").collect()))
    assert sorted(map(tuple, L.first_ready_rows(spark, f"{scratch}/r").select("order_id", "ts", "seq", "status").collect())) == want
    told = [r.order_id for r in L.announcements(spark, f"{scratch}/r").orderBy("batch").collect()]
    # a is the newest-created of its batch; e beats d by id; c only if it was not announced with an earlier batch
    assert told == (["a", "c", "e"] if order == (0, 1, 2) else ["e", "a"])


def test_delivery_cycle_and_replays(spark, scratch):
    table = Buckets(spark, f"{scratch}/subs", "endpoint", 4)
    codes = {"ok": 201, "gone": 404, "old": 410, "down": 500}
    table.load(spark.createDataFrame([(f"{k}-{o}", f"ep-{k}-{o}", o, "Ann Lee", k) for k in codes for o in ("o1", "o2")],
                                     "id string, endpoint string, order_id string, customer_name string, order_name string"))
    calls = []

    def send(outbox):
        calls.append(sorted(r.id for r in outbox.collect()))
        code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col("order_name")]
        return outbox.select("id", "endpoint", code.alias("status_code"))

    cycle = L.Deliveries(table, f"{scratch}/d", send)
    parts = [[("o1", T0, 1, "complete")], [("o2", T0 + DAY, 2, "making")], [("o1", T0 + DAY, 3, "making"), ("o1", T0 + 2 * DAY, 4, "complete")],
             [("o2", T0 + 3 * DAY, 5, "complete"), ("o2", T0 + 3 * DAY, 6, "making"), ("o2", T0 + 4 * DAY, 7, "complete")]]
    run(spark, scratch, parts, lambda s: L.stream_edges(s, f"{scratch}/e", f"{scratch}/ck", on_batch=cycle))
    every = ["down", "gone", "ok", "old"]
    assert calls == [[f"{k}-o1" for k in every], [], ["down-o1"], [f"{k}-o2" for k in every]]
    assert sorted(r.id for r in table.read().collect()) == ["down-o1", "down-o2"]
    assert cycle.outbox().count() == cycle.outbox().select("message_id").distinct().count() == 9
    # a batch that is replayed after it was settled, and one whose outcomes were written but not settled
    again = spark.createDataFrame([("o1", T0, 1, "complete", None, 1)], "order_id string, ts timestamp_ntz, seq long, status string, prev_status string, op int")
    cycle(again, 3)
    fresh = Buckets(spark, f"{scratch}/subs2", "endpoint", 4)
    fresh.load(spark.read.parquet(f"{scratch}/subs/" + "v=00000000000000000000-*").drop("_b"))
    L.Deliveries(fresh, f"{scratch}/d", send)(again, 0)
    assert len(calls) == 4 and sorted(r.id for r in fresh.read().collect()) == ["down-o1", "down-o2", "gone-o2", "ok-o2", "old-o2"]
