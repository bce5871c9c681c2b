"""The domain views are usable from SQL, and SQL plans like the DataFrame code."""

from orderflow.operators import ranking as R
from orderflow.plans import adapters as V

SMOKE = "/root/testdata/sf0.001"


def test_sql_over_views(spark):
    names = V.register_views(spark, SMOKE, prefix="of_")
    assert "of_queue" in names and spark.catalog.tableExists("of_archive")
    sql = spark.sql("""
        SELECT id, status FROM of_queue WHERE status <> 'complete'
    """)
    df = R.active_orders(V.queue(spark, SMOKE)).select("id", "status")
    assert sql.exceptAll(df).count() == 0 and df.exceptAll(sql).count() == 0
    top = spark.sql("""
        SELECT drink, count(*) AS cnt FROM of_archive GROUP BY drink ORDER BY cnt DESC, drink LIMIT 3
    """).collect()
    assert len(top) == 3 and top[0].cnt >= top[1].cnt >= top[2].cnt
    plan = spark.sql("SELECT count(*) FROM of_archive WHERE archived_at >= TIMESTAMP_NTZ '1998-06-15 07:00:00'") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan       # the predicate reaches the scan through the view
