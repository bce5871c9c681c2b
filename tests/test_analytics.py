import datetime as dt

from orderflow.operators import analytics as A

ARCH = "archived_at timestamp_ntz, drink string, temperature string, milk string, syrups string"
AS_OF = dt.datetime(2024, 3, 6, 20)          # Wednesday; the local week holds the DST change


def test_weekly_summary_bounds_and_lists(spark):
    start, end = A.week_bounds(AS_OF, 0)
    us = dt.timedelta(microseconds=1)
    rows = [(start, "Latte", "hot", "Oat", "A,,B"), (end - us, "Latte", " Cold ", " ", " A , B "),
            (end, "Mocha", "Hot", "Oat", "A"),                       # next week
            (start - us, "Mocha", "Hot", "Oat", "A"),                 # previous week
            (start, " ", None, None, None), (start, "Tea", "HOT", "Soy", "")]
    df = spark.createDataFrame(rows, ARCH)
    r = A.weekly_summary(df, AS_OF, 0).first()
    assert (r.week_start, r.week_end) == (start, end) and end - start == dt.timedelta(hours=167)
    assert (r.total_orders, r.hot_orders, r.cold_orders) == (4, 2, 1)
    assert [(x.item, x["count"]) for x in r.top_drinks] == [("Latte", 2), ("Tea", 1)]
    assert [(x.item, x["count"]) for x in r.top_milks] == [("Oat", 1), ("Soy", 1)]
    assert [(x.item, x["count"]) for x in r.top_syrups] == [("A", 2), ("B", 2)]
    prev = A.weekly_summary(df, AS_OF, -1).first()
    assert prev.total_orders == 1 and prev.week_offset == -1


def test_empty_week_gives_one_row(spark):
    df = spark.createDataFrame([], ARCH)
    r = A.weekly_summary(df, AS_OF, 0).collect()
    assert len(r) == 1 and r[0].total_orders == 0 and r[0].top_drinks == [] and r[0].top_syrups == []


def test_top_k_cap_and_ties(spark):
    start, _ = A.week_bounds(AS_OF, 0)
    rows = [(start, d, "Hot", None, None) for d in ["b", "a", "c", "d", "e", "f", "f"]]
    r = A.weekly_summary(spark.createDataFrame(rows, ARCH), AS_OF, 0).first()
    assert [x.item for x in r.top_drinks] == ["f", "a", "b", "c", "d"]


def test_trend_equals_summary(spark):
    rows = []
    for i in range(60):
        t = dt.datetime(2024, 2, 20) + dt.timedelta(hours=7 * i)
        rows.append((t, ["Latte", "Mocha", "Tea"][i % 3], ["Hot", "Cold"][i % 2], ["Oat", "Soy", ""][i % 3],
                     ["A, B", "B", ""][i % 3]))
    df = spark.createDataFrame(rows, ARCH)
    trend = {r.week_start: r for r in A.weekly_trend(df).collect()}
    for off in (-2, -1, 0):
        s = A.weekly_summary(df, AS_OF, off).first()
        t = trend[s.week_start]
        assert t.week_end == s.week_end
        assert (t.total_orders, t.hot_orders, t.cold_orders) == (s.total_orders, s.hot_orders, s.cold_orders)
        assert t.top_drinks == s.top_drinks and t.top_syrups == s.top_syrups and t.top_milks == s.top_milks


def test_popularity_and_delivery(spark):
    df = spark.createDataFrame([(None, "Latte", None, None, None), (None, " ", None, None, None)], ARCH)
    assert [(r.drink, r.cnt) for r in A.popularity(df, "drink").collect()] == [("Latte", 1)]
    out = spark.createDataFrame([("1", "e", c) for c in (201, 404, 410, 500, 200)], "id string, endpoint string, status_code int")
    r = A.delivery_summary(out).first()
    assert (r.sent, r.removed) == (2, 4)
    assert tuple(A.delivery_summary(out.filter("false")).first()) == (0, 0)
