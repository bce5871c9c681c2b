import datetime as dt

from pyspark.sql import functions as F

from orderflow.operators import notify as N
from orderflow.plans import reports as Q

T0 = dt.datetime(2024, 1, 1)
SUB = "id string, order_id string, endpoint string, customer_name string, order_name string, " \
      "created_at timestamp_ntz, updated_at timestamp_ntz, seq long"


def subs(spark):
    return spark.createDataFrame([
        ("s1", "o1", "e1", " Ann ", "Latte", T0, T0, 1),
        ("s2", "o1", "e2", None, None, T0, T0, 2),
        ("s3", "o2", "e3", "Bo", "Mocha", T0, T0, 3),
        ("s4", "o2", "e4", "Bo", "Mocha", T0, T0, 4),
        ("s5", "o3", "e5", "Cy", "Tea", T0, T0, 5)], SUB)


def test_current_subscriptions_one_endpoint_many_times(spark):
    ups = spark.createDataFrame([
        ("s1", "o1", "e1", "A", "x", T0, T0, 1),
        ("s2", "o2", "e1", "A", "y", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=1), 2),
        ("s3", "o3", "e1", "A", "z", T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=2), 3)], SUB)
    r = N.current_subscriptions(ups).collect()
    assert len(r) == 1 and r[0].id == "s1" and r[0].created_at == T0 and r[0].order_id == "o3"
    later = spark.createDataFrame([("s9", "o4", "e1", "A", "w", T0 + dt.timedelta(days=1),
                                    T0 + dt.timedelta(days=1), 9)], SUB)
    r2 = N.subscribe(N.current_subscriptions(ups), later).collect()
    assert len(r2) == 1 and r2[0].id == "s1" and r2[0].order_id == "o4" and r2[0].created_at == T0


def test_notify_and_settle(spark):
    ready = spark.createDataFrame([("o1",), ("o1",), ("o2",)], "order_id string")
    t = N.notify_targets(ready, subs(spark)).collect()
    bodies = {r.endpoint: r.payload.body for r in t}
    assert set(bodies) == {"e1", "e2", "e3", "e4"}
    assert bodies["e1"] == "Ann, your order is ready. Please go to the kitchen. Order: Latte"
    assert bodies["e2"] == "Your order is ready. Please go to the kitchen."
    out = spark.createDataFrame([("s1", "e1", 201), ("s2", "e2", 500), ("s3", "e3", 410), ("x", "e5", 404)],
                                "id string, endpoint string, status_code int")
    kept, summary = N.settle(subs(spark), out)
    assert sorted(r.id for r in kept.collect()) == ["s2", "s4"]      # success by id; 404/410 by endpoint
    s = summary.first()
    assert (s.sent, s.removed) == (1, 3)


def test_retention_job(spark):
    kept, removed = N.retention_job(subs(spark).withColumn(
        "created_at", F.when(F.col("id") == "s5", F.lit(T0 + dt.timedelta(days=40))).otherwise(F.col("created_at"))),
        T0 + dt.timedelta(days=45), 30)
    assert [r.id for r in kept.collect()] == ["s5"] and removed.first().removed == 4


def test_reports_run(spark):
    orders = spark.createDataFrame([
        ("1", T0, "Ann Lee", None, "Latte", "Hot", None, "", [], "", "making"),
        ("2", T0, "Bo Ma", None, "Tea", None, "Cold", "", [], "", "waiting"),
        ("3", T0 + dt.timedelta(minutes=3), "Cy Do", None, "Tea", "Hot", None, "", [], "", "ready")],
        "id string, created_at timestamp_ntz, customer_name string, name string, drink string, "
        "temperature string, temp string, milk string, syrups array<string>, notes string, status string")
    board, strip = Q.display_report(orders)
    assert [(r.id, r.position, r.wait) for r in board.orderBy("position").collect()] == [
        ("1", 1, "Now"), ("2", 2, "~4 min")]
    assert [r.id for r in strip.collect()] == ["3"]
    rep = Q.orders_report(orders).orderBy("position").collect()
    assert [(r.id, r.position, r.orders_ahead, r.temp) for r in rep] == [("1", 1, 0, "Hot"), ("2", 2, 1, "Cold"),
                                                                       ("3", 3, 2, "Hot")]
    settings = spark.createDataFrame([("isOpen", '"true"'), ("message", '"Back at 9"')], "key string, value string")
    st = Q.status_report(settings).first()
    assert st.is_open and st.message == "Back at 9"
    changes = spark.createDataFrame([("message", None), ("isOpen", '"false"')], "key string, value string")
    assert {r.key: r.value for r in Q.update_settings(settings, changes).collect()} == {
        "isOpen": '"false"', "message": '"Back at 9"'}
    snap, missing, invalid = Q.update_status(orders, spark.createDataFrame(
        [("2", "COMPLETE"), ("9", "making"), ("1", "done")], "id string, status string"))
    got = {r.id: (r.status, r.position) for r in snap.collect()}
    assert got == {"1": ("making", 1), "2": ("complete", None), "3": ("ready", 2)}
    assert [r.id for r in missing.collect()] == ["9"] and [r.id for r in invalid.collect()] == ["1"]


def test_reports_with_only_complete_orders(spark):
    orders = spark.createDataFrame([
        ("1", T0, "Ann Lee", None, "Latte", "Hot", None, "", [], "", "complete")],
        "id string, created_at timestamp_ntz, customer_name string, name string, drink string, "
        "temperature string, temp string, milk string, syrups array<string>, notes string, status string")
    assert Q.orders_report(orders).count() == 0
    board, strip = Q.display_report(orders)
    assert board.count() == 0 and [r.id for r in strip.collect()] == ["1"]
    empty = orders.filter("false")
    board, strip = Q.display_report(empty)
    assert board.count() == 0 and strip.count() == 0
