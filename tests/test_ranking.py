import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import ranking as R

T0 = dt.datetime(2024, 1, 1)


def orders(spark, rows):
    return spark.createDataFrame(rows, "id string, created_at timestamp_ntz, status string, shop int")


def test_ties_and_ready_counted(spark):
    # two orders share created_at; a ready order sits between two waiting ones
    df = orders(spark, [("b", T0, "waiting", 1), ("a", T0, "waiting", 1),
                        ("c", T0 + dt.timedelta(minutes=1), "ready", 1),
                        ("d", T0 + dt.timedelta(minutes=2), "waiting", 1),
                        ("e", T0, "complete", 1), ("f", T0, None, 1)])
    got = {r.id: r.position for r in R.fifo_position(df).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}
    board = {r.id: r.position for r in R.board_position(df).collect()}
    assert board == {"a": 1, "b": 2, "d": 3}


def test_sorted_equals_window_with_hot_keys(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        hot = rnd.random() < 0.4            # a third or more of rows on one timestamp and one shop
        ts = T0 if hot else T0 + dt.timedelta(minutes=rnd.randint(0, 500))
        shop = 0 if hot else rnd.randint(1, 20)
        rows.append((f"id{i:05d}", ts, rnd.choice(["waiting", "making", "ready", "complete"]), shop))
    df = orders(spark, rows)
    for by in ((), ("shop",)):
        a = R.fifo_position(df, by=by, partitions=7).select("id", "position")
        b = R.fifo_position(df, by=by, method="window").select("id", "position")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # positions are 1..n without gaps per shop
    p = R.fifo_position(df, by=("shop",))
    chk = p.groupBy("shop").agg(F.count("*").alias("n"), F.max("position").alias("mx"),
                                F.countDistinct("position").alias("d")).collect()
    assert all(r.n == r.mx == r.d for r in chk)


def test_global_position_plan_has_no_single_partition(spark):
    df = orders(spark, [(f"{i}", T0, "waiting", 1) for i in range(50)])
    plan = R.global_position(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def splice(lst, f, t):
    if f not in lst or t not in lst or f == t:
        return lst
    nxt = list(lst)
    i, j = nxt.index(f), nxt.index(t)
    x = nxt.pop(i)
    nxt.insert(j, x)
    return nxt


def test_move_item_equals_splicing(spark):
    rows, moves, expect = [], [], {}
    g = 0
    for n in range(1, 6):
        items = [f"i{k}" for k in range(n)]
        for f, t in itertools.product(items + ["zz"], items):
            g += 1
            rows += [(g, it, p) for p, it in enumerate(items)]
            moves.append((g, f, t))
            expect[g] = splice(items, f, t)
    df = spark.createDataFrame(rows, "list int, id string, sort_order int")
    mv = spark.createDataFrame(moves, "list int, from_id string, to_id string")
    out = R.move_item(df, mv, "list").collect()
    got = {}
    for r in out:
        got.setdefault(r.list, {})[r.sort_order] = r.id
    for k, v in expect.items():
        assert [got[k][i] for i in range(len(v))] == v, k


def test_swap_neighbour(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 0), (2, "b", 1)],
                               "list int, id string, sort_order int")
    mv = spark.createDataFrame([(1, "c", -1), (2, "b", 1)], "list int, from_id string, direction int")
    got = {(r.list, r.id): r.sort_order for r in R.swap_neighbour(df, mv, "list").collect()}
    assert got == {(1, "a"): 0, (1, "b"): 2, (1, "c"): 1, (2, "a"): 0, (2, "b"): 1}


def test_ready_edges_push_rule(spark):
    t = [T0 + dt.timedelta(minutes=i) for i in range(10)]
    rows = [("o1", t[0], 1, "waiting"), ("o1", t[1], 2, "ready"), ("o1", t[2], 3, "complete"),
            ("o1", t[3], 4, "making"), ("o1", t[4], 5, "complete"),
            ("o2", t[0], 6, "complete"),
            ("o3", t[0], 8, "making"), ("o3", t[0], 7, "complete")]
    df = spark.createDataFrame(rows, "order_id string, ts timestamp_ntz, seq long, status string")
    for m in ("sorted", "window"):
        got = sorted((r.order_id, r.seq) for r in R.ready_edges(df, method=m).collect())
        # waiting->ready->complete: no push; making->complete: push; first row complete: push
        assert got == [("o1", 5), ("o2", 6), ("o3", 7)], m
    disp = sorted((r.order_id, r.seq) for r in
                  R.ready_edges(df, fire_on=("ready", "complete"), done=("ready", "complete")).collect())
    assert disp == [("o1", 2), ("o1", 5), ("o2", 6), ("o3", 7)]
    first = sorted((r.order_id, r.seq) for r in R.first_ready(df).collect())
    assert first == [("o1", 2), ("o2", 6), ("o3", 7)]


def test_latest_per_keep_first(spark):
    rows = [("e1", "s1", 1, "o1"), ("e1", "s2", 2, "o2"), ("e1", "s3", 3, "o3"), ("e2", "s4", 1, "o9")]
    df = spark.createDataFrame(rows, "endpoint string, id string, seq long, order_id string")
    got = {r.endpoint: (r.id, r.order_id) for r in R.latest_per(df, "endpoint", ["seq"], keep_first=["id"]).collect()}
    assert got == {"e1": ("s1", "o3"), "e2": ("s4", "o9")}


def test_top_k_and_ready_strip(spark):
    rows = [(f"{i}", T0 + dt.timedelta(minutes=i % 3), "ready" if i % 2 else "complete", 1) for i in range(20)]
    df = orders(spark, rows)
    strip = R.ready_strip(df).collect()
    assert len(strip) == 8 and all(strip[i].created_at >= strip[i + 1].created_at for i in range(7))
    tk = R.top_k(df, ["shop"], 3, [F.col("created_at").desc(), F.col("id").desc()]).collect()
    assert len(tk) == 3


def test_lag_by_across_partitions_with_hot_key(spark):
    from pyspark.sql import Window
    rnd = random.Random(5)
    rows = []
    for i in range(4000):
        k = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 60)}"
        rows.append((k, T0 + dt.timedelta(seconds=rnd.randint(0, 50000)), i, rnd.choice(["a", "b", None, "c"])))
    df = spark.createDataFrame(rows, "order_id string, ts timestamp_ntz, seq long, status string")
    got = R.lag_by(df, "order_id", ["ts", "seq"], "status", "prev", partitions=5)
    w = Window.partitionBy("order_id").orderBy("ts", "seq")
    want = df.withColumn("prev", F.lag("status").over(w))
    assert got.count() == 4000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_several_moves_of_a_list_equal_one_by_one(spark):
    rng = random.Random(1)
    rows, moves, expect = [], [], {}
    for g in range(60):
        items = [f"i{k}" for k in range(rng.randrange(1, 9))]
        rows += [(g, it, p) for p, it in enumerate(items)]
        for k in range(rng.randrange(0, 7)):
            f = rng.choice([*items, "zz"])
            if rng.random() < 0.5:
                t = rng.choice([*items, "zz"])
                moves.append((g, k, f, t, None))
                items = splice(items, f, t)
            else:
                d = rng.choice([-1, 1])
                moves.append((g, k, f, None, d))
                if f in items and 0 <= items.index(f) + d < len(items):
                    items = splice(items, f, items[items.index(f) + d])
        expect[g] = items
    df = spark.createDataFrame([(*r, "kept") for r in rows], "list int, id string, sort_order int, extra string")
    mv = spark.createDataFrame(moves, "list int, n int, from_id string, to_id string, direction int")
    out = R.move_item(df, mv.orderBy(F.rand(3)), "list", order="n").collect()
    assert len(out) == len(rows) and {r.extra for r in out} == {"kept"}
    for g, items in expect.items():
        assert [r.id for r in sorted((r for r in out if r.list == g), key=lambda r: r.sort_order)] == items, g
    with pytest.raises(Exception, match="two moves of one list"):
        R.move_item(df, mv.filter("to_id is not null"), "list").collect()
