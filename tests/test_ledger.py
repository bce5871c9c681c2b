import datetime as dt

from pyspark.sql import functions as F

from orderflow.operators import archive as AR
from orderflow.operators import upsert as U
from orderflow.operators import filters as P

T0 = dt.datetime(2024, 1, 1)
ORD = "id string, created_at timestamp_ntz, customer_name string, name string, drink string, " \
      "temperature string, temp string, milk string, syrups array<string>, notes string, status string"


def ledger(spark):
    return spark.createDataFrame([
        ("1", T0, "Ann Lee", None, "Latte", "Hot", None, "Oat milk", ["Vanilla", None, "Mocha"], "", "complete"),
        ("2", T0, None, "Bo Ma", "Mocha", None, "Cold", None, None, None, "waiting"),
        ("3", T0, "Cy Do", None, "Tea", "Hot", None, "", [], "", None),
        ("4", T0, "Di Ek", None, "Tea", "Hot", None, "", [], "", "COMPLETE"),
    ], ORD)


def test_archive_split_disjoint_and_complete(spark):
    df = ledger(spark)
    arch, rest = AR.clear_completed(df, T0)
    ids_a = {r.original_order_id for r in arch.collect()}
    ids_r = {r.id for r in rest.collect()}
    assert ids_a == {"1"} and ids_r == {"2", "3", "4"}      # null status is kept, not lost
    row = arch.first()
    assert row.syrups == "Vanilla, Mocha" and row.customer_name == "Ann Lee"
    assert '"notes":""' in row.order_data and '"temp":null' in row.order_data


def test_clear_all_guard(spark):
    df = ledger(spark)
    open_ = spark.createDataFrame([("isOpen", '"true"')], "key string, value string")
    closed = spark.createDataFrame([("isOpen", '"false"'), ("message", '"bye"')], "key string, value string")
    empty = spark.createDataFrame([], "key string, value string")
    assert AR.clear_all(df, open_, T0)[0].count() == 0
    assert AR.clear_all(df, empty, T0)[0].count() == 0          # missing flag reads as open
    a, r = AR.clear_all(df, closed, T0)
    assert a.count() == 4 and r.count() == 0


def test_upsert_semantics(spark):
    tgt = spark.createDataFrame([("isOpen", '"true"'), ("message", '"hi"')], "key string, value string")
    upd = spark.createDataFrame([("message", None, 1), ("isOpen", '"false"', 1), ("isOpen", '"true"', 2),
                                 ("pin", '"1"', 1)], "key string, value string, seq long")
    got = {r.key: r.value for r in U.upsert(tgt, upd, "key", order_by=["seq"], ignore_null="value")
           .select("key", "value").collect()}
    assert got == {"isOpen": '"true"', "message": '"hi"', "pin": '"1"'}
    once = U.upsert(tgt, upd.filter("seq = 1 and value is not null").drop("seq"), "key")
    twice = U.upsert(once, upd.filter("seq = 1 and value is not null").drop("seq"), "key")
    assert sorted(once.collect()) == sorted(twice.collect())    # idempotent


def test_keep_first_and_insert_absent(spark):
    tgt = spark.createDataFrame([("e1", "s1", T0, "o1")], "endpoint string, id string, created_at timestamp_ntz, order_id string")
    upd = spark.createDataFrame([("e1", "s9", T0 + dt.timedelta(days=3), "o2"), ("e2", "s8", T0, "o3")],
                                "endpoint string, id string, created_at timestamp_ntz, order_id string")
    got = {r.endpoint: (r.id, r.created_at, r.order_id) for r in
           U.upsert(tgt, upd, "endpoint", keep_first=("id", "created_at")).collect()}
    assert got == {"e1": ("s1", T0, "o2"), "e2": ("s8", T0, "o3")}
    seed = spark.createDataFrame([("e1", "x", T0, "z"), ("e3", "y", T0, "w")], tgt.schema)
    assert {r.endpoint: r.id for r in U.insert_absent(tgt, seed, "endpoint").collect()} == {"e1": "s1", "e3": "y"}


def test_apply_updates_and_delete(spark):
    inv = spark.createDataFrame([("Oat milk", True), ("Soy milk", True)], "item string, available boolean")
    ch = spark.createDataFrame([("Oat milk", False), ("Rice milk", False)], "item string, available boolean")
    snap, missing = U.apply_updates(inv, ch, "item", ["available"])
    assert {r.item: r.available for r in snap.collect()} == {"Oat milk": False, "Soy milk": True}
    assert [r.item for r in missing.collect()] == ["Rice milk"]
    df = spark.createDataFrame([(1, T0), (2, None), (3, T0 + dt.timedelta(days=40))], "id int, created_at timestamp_ntz")
    as_of = T0 + dt.timedelta(days=45)
    kept, removed = U.delete_where(df, F.col("created_at") < F.lit(as_of - dt.timedelta(days=30)))
    assert sorted(r.id for r in kept.collect()) == [2, 3] and removed.count() == 1
    assert U.change_count(removed).first()[0] == 1
    # null or 0 days mean one day; a row exactly at the cutoff is kept
    for days, n in ((None, 1), (0, 1), (30, 2), (44, 2), (45, 3), (5, 2)):
        assert P.retain(df, "created_at", days, as_of).count() == n, days


def test_settings_scalar(spark):
    s = spark.createDataFrame([("isOpen", '"false"'), ("message", '"say ""hi"""')], "key string, value string")
    row = P.setting_row(s, {"isOpen": "true", "message": "", "other": "x"}).first()
    assert row.isOpen == "false" and row.other == "x"
    df = spark.range(3)
    assert df.filter(P.is_open(s)).count() == 0


def test_two_updates_of_one_key(spark):
    import pytest
    tgt = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    upd = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 3)], "key string, value int, seq int")
    with pytest.raises(Exception, match="two updates of one key"):
        U.upsert(tgt, upd.drop("seq"), "key").collect()
    with pytest.raises(Exception, match="two updates of one key"):
        U.apply_updates(tgt, upd, "key", ["value"])[0].collect()
    snap, missing = U.apply_updates(tgt, upd, "key", ["value"], order_by="seq")
    assert sorted((r.key, r.value) for r in snap.collect()) == [("a", 6), ("b", 2)]
    assert [(r.key, r.value) for r in missing.collect()] == [("c", 7)]


def test_lookup_leaves_the_table_in_place(spark):
    from orderflow.operators.filters import lookup
    t = spark.range(200000).selectExpr("cast(id as string) id", "id as v")
    ids = spark.createDataFrame([("5",), ("7",), ("none",)], "id string")
    got = lookup(t, ids)
    assert sorted((r.requested_id, r.v) for r in got.collect()) == [("5", 5), ("7", 7), ("none", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Range (0, 200000")].splitlines()
    first_join = next(x for x in reversed(above) if "Join" in x)
    assert "BroadcastHashJoin" in first_join, plan
