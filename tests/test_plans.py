"""Plan checks: pushdown, pruning, no single-partition exchange on facts."""

from orderflow.operators import analytics as A
from orderflow.operators import ranking as R
from orderflow.plans import adapters as V

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weekly_summary_pushes_range_to_scan(spark):
    p = plan(A.weekly_summary(V.archive(spark, SMOKE), V.ARCHIVE_AS_OF, 0))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    # only the needed lineitem columns are read
    assert "ReadSchema: struct<l_partkey:bigint,l_linestatus:string,l_shipdate:timestamp_ntz>" in p


def test_positions_without_single_partition_on_facts(spark):
    df = R.fifo_position(V.queue(spark, SMOKE))
    p = plan(df)
    assert "SinglePartition" not in p.split("BroadcastExchange")[0]
    assert "BroadcastExchange" in p                # the offsets table (one row per partition)
    assert df.count() > 0


def test_catalogue_joins_become_broadcast_after_measuring(spark):
    """The menu and stock sides are small here, so AQE turns their joins
    into broadcast joins at run time (nothing is hinted)."""
    from orderflow.operators import orders as O
    df = O.enrich_orders(V.last_order(spark, SMOKE), V.menu(spark, SMOKE), V.inventory(spark, SMOKE))
    df.collect()
    p = plan(df)
    assert "isFinalPlan=true" in p and "BroadcastHashJoin" in p


def test_queue_orders_shuffle_lines_once(spark):
    """the distinct lines and their join with the orders share one shuffle by the order."""
    df = V.queue_orders(spark, SMOKE)
    assert df.count() == df.select("id").distinct().count() > 0
    lines = [x for x in plan(df).split("\n") if "Exchange hashpartitioning" in x and "l_suppkey" in x]
    assert not lines


def test_menu_documents_list_lines_once(spark, scratch):
    """an order's lines are dealt once, as they are read, and listed once; lines without a name or a number stay."""
    import json

    from orderflow.plans.catalog_queries import _menu_docs
    spark.createDataFrame([(7, 2, 1, 1), (7, 1, 2, 1), (7, 1, 2, 1), (8, None, 3, 1), (8, 1, 1, None), (9, 1, 99, 1)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{scratch}/lineitem.parquet")
    spark.createDataFrame([(1, "red gear", "Brand#1", "SMALL", 6), (2, "blue red", "Brand#2", "LARGE", 5), (3, None, "Brand#3", "PROMO", 4)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{scratch}/part.parquet")
    docs = _menu_docs(spark, scratch)
    got = {r.doc_id: [json.loads(x) for x in r[1:]] for r in docs.collect()}
    small = {"id": "  ", "label": "red gear", "temps": ["Cold", "Hot", "Cold"], "milk": "no"}
    large = {"id": "large", "label": "blue red", "temps": ["Warm"], "milk": "yes", "active": "off"}
    promo = {"id": "promo", "temps": ["Cold", "Hot", "Cold"], "milk": "yes"}
    milk = {n: {"item": f"Brand#{n}", "available": str(n != 3).lower()} for n in (1, 2, 3)}
    assert got == {7: [[large, large, small], [milk[2], milk[2], milk[1]], [{"item": w} for w in ("blue", "red", "gear")]],
                   8: [[promo, small], [milk[3], milk[1]], [{"item": "red"}, {"item": "gear"}]]}
    p = plan(docs).split("Initial Plan")[-1]
    assert p.count("Exchange hashpartitioning(l_orderkey") == 1
    text = docs._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("collect_list") == 1 and text.count("RepartitionByExpression") == 1
