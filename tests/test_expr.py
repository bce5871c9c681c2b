import datetime as dt

from pyspark.sql import functions as F

from orderflow.functions import expr as X


def one(spark, col, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_slug_forms(spark):
    rows = [("  Oat Milk! ",), ("--Brand#1--",), ("",), (None,)]
    assert one(spark, X.slug("v"), rows) == ["oat-milk", "brand-1", "", ""]
    assert one(spark, X.slug("v", fallback=F.lit("drink")), rows)[2] == "drink"
    assert one(spark, X.slug("v", strip=False), rows)[:2] == ["-oat-milk-", "-brand-1-"]


def test_unquote_and_blank(spark):
    assert one(spark, X.unquote("v"), [('"true"',), ('""',), ('say "hi"',)]) == ["true", "", 'say "hi']
    assert one(spark, X.blank_to_null("v"), [(" ",), ("",), (None,), (" a ",)]) == [None, None, None, "a"]


def test_bool_text(spark):
    rows = [("on",), (" Yes",), ("0",), ("OFF",), ("bad",), (None,), ("f",)]
    assert one(spark, X.bool_text("v", True), rows) == [True, True, False, False, True, True, False]
    assert one(spark, X.bool_text("v"), rows)[4] is None


def test_clamp_archive_limit(spark):
    from orderflow.operators.ranking import archive_limit
    assert [archive_limit(n) for n in (None, 0, 25, 51, -3)] == [25, 1, 25, 50, 1]
    assert one(spark, X.clamp("v", 1, 50), [(None,), (0,), (70,)], "v int") == [50, 1, 50]


def test_text_list_and_list_text(spark):
    rows = [("",), (" ",), ("A",), ("A,,B",), (" A , B ",), (None,)]
    got = one(spark, F.filter(X.text_list(X.blank_to_null("v")), lambda s: X.blank_to_null(s).isNotNull()), rows)
    assert got == [[], [], ["A"], ["A", "B"], ["A", "B"], []]
    assert one(spark, X.list_text("v"), [(["a", None, "b"],), (None,)], "v array<string>") == ["a, b", ""]


def test_week_start_dst(spark):
    # Los Angeles: DST starts 2024-03-10, ends 2024-11-03; weeks are 167 and 169 hours
    rows = [(dt.datetime(2024, 3, 12, 12),), (dt.datetime(2024, 11, 5, 12),), (dt.datetime(2024, 3, 11, 6, 59, 59),)]
    df = spark.createDataFrame(rows, "v timestamp_ntz")
    got = df.select(X.week_start("v").alias("s"), X.week_start("v", n=1).alias("e")).collect()
    assert got[0]["s"] == dt.datetime(2024, 3, 11, 7) and got[0]["e"] == dt.datetime(2024, 3, 18, 7)
    assert got[1]["s"] == dt.datetime(2024, 11, 4, 8)
    # 06:59:59 UTC on Monday 11 March is still Sunday in Los Angeles
    assert got[2]["s"] == dt.datetime(2024, 3, 4, 8)
    from orderflow.operators.analytics import week_bounds
    s, e = week_bounds(dt.datetime(2024, 3, 6, 12), 0)
    assert (e - s) == dt.timedelta(hours=167)
    s, e = week_bounds(dt.datetime(2024, 11, 1, 12), 0)
    assert (e - s) == dt.timedelta(hours=169)


def test_age_and_wait_texts(spark):
    as_of = dt.datetime(2024, 1, 1, 12, 0)
    rows = [(as_of,), (as_of - dt.timedelta(minutes=5),), (as_of - dt.timedelta(hours=2),),
            (as_of - dt.timedelta(minutes=135),), (None,), (as_of + dt.timedelta(hours=1),)]
    got = one(spark, X.age_text("v", F.lit(as_of)), rows, "v timestamp_ntz")
    assert got == ["just now", "5 min ago", "2 hr ago", "2 hr 15 min ago", "", "just now"]
    pos = [(1,), (2,), (7,), (None,)]
    assert one(spark, X.wait_text("v"), pos, "v int")[:3] == ["You're up next", "Estimated wait: ~4 min",
                                                              "Estimated wait: ~24 min"]
    assert one(spark, X.ahead_text("v"), pos, "v int")[:3] == ["No orders ahead of you.", "1 order ahead of you.",
                                                               "6 orders ahead of you."]
    assert one(spark, X.orders_ahead("v"), pos, "v int") == [0, 1, 6, None]
    assert one(spark, X.ticket_no("v"), [(1,), (7,), (1234,), (None,)], "v int") == ["001", "007", "1234", None]


def test_names(spark):
    rows = [("A",), (" A  B ",), ("",), (None,), ("\tJo Ann ",)]
    assert one(spark, X.first_name("v"), rows) == ["A", "A", "Guest", "Guest", "Jo"]
    assert one(spark, X.word_count("v"), rows) == [1, 2, 0, 0, 2]


def test_summary_status_whitelist(spark):
    df = spark.createDataFrame([("Hot", "Latte", "Oat milk", ["Vanilla", "Mocha"]), ("", "Latte", "", [])],
                               "t string, l string, m string, s array<string>")
    assert [r[0] for r in df.select(X.order_summary("t", "l", "m", "s")).collect()] == [
        "Hot · Latte · Oat milk · Vanilla, Mocha", "Latte"]
    assert one(spark, X.status_label("v"), [("making",), ("ready",), ("complete",), ("waiting",), (None,)]) == [
        "Being made", "Ready for pickup", "Ready for pickup", "Waiting", "Waiting"]
    temps = [([],), (["Cold", "Hot", "Cold"],), (["Warm"],), (None,)]
    assert one(spark, X.whitelist("v"), temps, "v array<string>") == [["Hot"], ["Hot", "Cold"], ["Hot"], ["Hot"]]
    assert one(spark, X.distinct_list("v"), temps[:2], "v array<string>") == [[], ["Cold", "Hot"]]


def test_cap_list_and_position_or(spark):
    df = spark.createDataFrame([(["A", "B", "C"],)], "v array<string>")
    allowed = F.array(F.lit("C"), F.lit("A"))
    assert df.select(X.cap_list("v", allowed, 2)).first()[0] == ["A", "C"]
    assert df.select(X.cap_list("v", None, 2)).first()[0] == ["A", "B"]
    got = spark.createDataFrame([(3, 5), (0, 5), (None, 2), (None, None)], "p int, a int").select(
        X.position_or("p", "a")).collect()
    assert [r[0] for r in got] == [3, 6, 3, None]


def test_ready_message(spark):
    df = spark.createDataFrame([("  Ann ", " Latte ", "a b/c"), (None, "", "x")], "n string, o string, i string")
    got = df.select(X.ready_message("n", "o", "i").alias("m")).collect()
    assert got[0]["m"]["body"] == "Ann, your order is ready. Please go to the kitchen. Order: Latte"
    assert got[0]["m"]["url"] == "/?order=a%20b%2Fc"
    assert got[1]["m"]["body"] == "Your order is ready. Please go to the kitchen."
    assert got[0]["m"]["title"] == "Order ready"
    shop = df.select(X.ready_message("n", "o", "i", title="Corner Cafe").alias("m")).first()
    assert shop["m"]["title"] == "Corner Cafe"


def test_week_label(spark):
    got = one(spark, X.week_label("v"), [(0,), (-1,), (-3,), (1,), (2,)], "v int")
    assert got == ["This week", "Last week", "3 weeks ago", "1 week ahead", "2 weeks ahead"]
