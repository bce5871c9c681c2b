import datetime as dt
import random

from pyspark.sql import functions as F

from orderflow.operators import orders as O
from orderflow.operators.rank_index import RankIndex

SCHEMA = ("id string, created_at timestamp_ntz, customer_name string, name string, drink string, temperature string, temp string, "
          "milk string, syrups array<string>, notes string, status string")
T0 = dt.datetime(2024, 1, 1)


def made_up(ids, seed=0):
    rng = random.Random(seed)
    return [(str(i), rng.choice([T0, T0, T0 + dt.timedelta(days=rng.randrange(20))]), f"n{i}", None, "tea", "Hot", None, "", [], "",
             rng.choice(["waiting", "making", "ready", "complete", None])) for i in ids]


def same(index, ids, ledger):
    got, want = index.order_status(ids), O.order_status(ids, ledger)
    cols = ["requested_id", "found", "status", "position", "orders_ahead", "name"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def scans(df):
    """Files read by each scan, as Spark counted them."""
    df.write.format("noop").mode("overwrite").save()
    out = []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if "FileSourceScanExec" in p.getClass().getSimpleName():
            out.append((p.relation().location().rootPaths().head().toString(), p.metrics().apply("numFiles").value()))
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_equal_to_the_full_ranking_through_batches(spark, scratch):
    first, more = made_up(range(400)), made_up(range(400, 700), 1)
    ledger = spark.createDataFrame(first, SCHEMA)
    index = RankIndex(spark, f"{scratch}/ix", rows=40, buckets=4).build(ledger)
    ids = spark.createDataFrame([(str(i),) for i in range(-5, 720)], "id string")
    assert len(index._state()[2]) > 5
    same(index, ids, ledger)
    placed = spark.createDataFrame(more, SCHEMA)
    placed_rows = index.place_orders(0, placed)
    whole = ledger.unionByName(placed)
    same(index, ids, whole)
    want = {r.requested_id: r.position for r in O.order_status(placed.select("id"), whole).collect()}
    assert {r.id: r.position for r in placed_rows.collect()} == want
    rng = random.Random(3)
    new = {str(i): rng.choice(["complete", "waiting", None]) for i in rng.sample(range(700), 250)}
    changes = spark.createDataFrame(list(new.items()), "id string, status string")
    index.apply(1, changes=changes)
    after = whole.join(changes.withColumnRenamed("status", "_s").withColumn("_hit", F.lit(True)), "id", "left").withColumn(
        "status", F.when(F.col("_hit"), F.col("_s")).otherwise(F.col("status"))).drop("_s", "_hit")
    same(index, ids, after)
    version = index._state()[0]
    index.apply(1, changes=changes)
    assert index._state()[0] == version                     # a replayed batch is a no-op
    assert max(d[3] for d in index._state()[2]) < 3 * 40    # ranges are cut again as they grow


def test_reads_only_what_is_asked_for(spark, scratch):
    ledger = spark.createDataFrame(made_up(range(2000)), SCHEMA)
    index = RankIndex(spark, f"{scratch}/ix", rows=100, buckets=16).build(ledger.withColumn("status", F.lit("waiting")))
    ids = spark.createDataFrame([("7",), ("nobody",)], "id string")
    read = scans(index.order_status(ids))
    entries = [n for path, n in read if "/entries/" in path]
    ledgers = [n for path, n in read if "/ledger/" in path]
    assert entries and max(entries) <= 2 and ledgers and max(ledgers) <= 2, read
    assert len(index._state()[2]) >= 15


def test_an_empty_ledger(spark, scratch):
    index = RankIndex(spark, f"{scratch}/ix", rows=10, buckets=2).build(spark.createDataFrame([], SCHEMA))
    index.apply(0, placed=spark.createDataFrame(made_up(range(30)), SCHEMA))
    ids = spark.createDataFrame([(str(i),) for i in range(31)], "id string")
    same(index, ids, spark.createDataFrame(made_up(range(30)), SCHEMA))
