import datetime as dt
import json

from pyspark.sql import functions as F

from orderflow.sources import readers as SR
from orderflow.sources import schemas as S
from orderflow.sources import sinks as SK


def test_order_grid(spark, scratch):
    path = f"{scratch}/grid.csv"
    with open(path, "w") as f:
        f.write("Order ID,Time,Name,Drink,Temp,Milk,Syrups,Notes,Status\n")
        f.write("a1,2024-01-01 08:00:00,Ann Lee,Latte,Hot,Oat milk,\"Vanilla, Mocha\",,MAKING\n")
        f.write(",2024-01-01 08:01:00,Bo,Tea,,,,,\n")
        f.write("c3,not a time,Cy,Mocha,Cold,,,x,complete\n")
    rows = SR.ingest_order_grid(SR.read_grid(spark, path, S.ORDER_GRID))
    got = {r.name: r for r in rows.collect()}
    assert got["Ann Lee"].status == "making" and got["Bo"].status == "waiting" and got["Bo"].id == ""
    assert got["Bo"].notes == "" and got["Ann Lee"].syrups == "Vanilla, Mocha"
    conf = SR.conform(rows.withColumn("created_at", F.col("time")), S.ORDERS, defaults={"status": "waiting"},
                      renames=S.ORDER_RENAMES)
    c = {r.customer_name: r for r in conf.collect()}
    assert [(f.name, f.dataType) for f in conf.schema] == [(f.name, f.dataType) for f in S.ORDERS]
    assert c["Ann Lee"].created_at == dt.datetime(2024, 1, 1, 8) and c["Cy"].created_at is None
    assert c["Ann Lee"].syrups == ["Vanilla", "Mocha"] and c["Bo"].syrups == []
    assert c["Ann Lee"].temperature == "Hot"


def test_inventory_grid_with_defaults(spark, scratch):
    path = f"{scratch}/inv.csv"
    with open(path, "w") as f:
        f.write("Item,Type,Available\n Oat milk , MILK ,FALSE\nSoy milk,milk,no\n ,milk,true\nFoam,topping,true\n")
    defaults = spark.createDataFrame([("Caramel", "syrup", True), ("Whole milk", "milk", True)],
                                     "item string, type string, available boolean")
    got = {(r.item, r.type): r.available for r in
           SR.ingest_inventory_grid(SR.read_grid(spark, path, S.INVENTORY_GRID), defaults).collect()}
    # milk rows present, so only the syrup defaults fill in; only 'false' means out of stock
    assert got == {("Oat milk", "milk"): False, ("Soy milk", "milk"): True, ("Caramel", "syrup"): True}


def test_order_json(spark):
    docs = spark.createDataFrame([
        ("1", json.dumps({"name": "Ann Lee", "drink": "Latte", "temp": "Hot", "milk": "Oat milk",
                          "syrups": ["Vanilla"], "notes": "hot!", "drinkId": "latte"})),
        ("2", json.dumps({"name": "Bo"})), ("3", "not json")], "id string, doc string")
    got = {r.id: r for r in SR.ingest_order_json(docs).collect()}
    assert got["1"].syrups == ["Vanilla"] and got["1"].temperature == "Hot" and "drinkId" not in got["1"].asDict()
    assert got["2"].drink == "" and got["2"].syrups == [] and got["2"].status == "waiting"
    assert got["3"].customer_name == "" and got["3"].syrups == []


def test_append_and_snapshot(spark, scratch):
    t0 = dt.datetime(2024, 1, 1, 9)
    df = spark.createDataFrame([(str(i), t0 + dt.timedelta(hours=13 * i)) for i in range(30)],
                               "id string, created_at timestamp_ntz")
    SK.append(df.filter("id < '2'"), f"{scratch}/ledger")
    SK.append(df.filter("id >= '2'"), f"{scratch}/ledger")
    back = spark.read.parquet(f"{scratch}/ledger")
    assert back.count() == 30 and back.select("dt").distinct().count() == 17
    SK.replace_snapshot(df, f"{scratch}/cat", "a")
    SK.replace_snapshot(df.limit(3), f"{scratch}/cat", "b")
    assert SK.read_current(spark, f"{scratch}/cat").count() == 3
    assert spark.read.parquet(f"{scratch}/cat/v=a").count() == 30      # the old version is untouched
    js = SR.to_json_rows(spark.createDataFrame([("x", None)], "a string, b string")).first()[0]
    assert js == '{"a":"x","b":null}'


def test_inventory_grid_sheet_defaults(spark, scratch):
    path = f"{scratch}/inv2.csv"
    with open(path, "w") as f:
        f.write("Item,Type,Available\nVanilla,syrup,false\n")
    got = {(r.item, r.type): r.available for r in
           SR.ingest_inventory_grid(SR.read_grid(spark, path, S.INVENTORY_GRID), SR.sheet_defaults(spark)).collect()}
    assert got[("Vanilla", "syrup")] is False and ("Caramel", "syrup") not in got     # syrups present
    assert {k for k in got if k[1] == "milk"} == {("Almond milk", "milk"), ("Oat milk", "milk"), ("Soy milk", "milk")}


def test_bucketed_tables_join_without_shuffle(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(str(i), t0, "waiting") for i in range(200)],
                                   "id string, created_at timestamp_ntz, status string")
    changes = spark.createDataFrame([(str(i % 50), "making", i) for i in range(300)],
                                    "id string, status string, seq long")
    SK.save_bucketed(orders, "of_orders_b", "id", 8, f"{scratch}/ob")
    SK.save_bucketed(changes, "of_changes_b", "id", 8, f"{scratch}/cb")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("of_orders_b").join(spark.table("of_changes_b").withColumnRenamed("status", "new"), "id")
        assert j.count() == 300
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
