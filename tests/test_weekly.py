"""Stored weekly counts, weeks that close on a stream, and quarantined rows."""

import datetime as dt
import random

import pytest

from orderflow.functions import expr as X
from orderflow.operators import analytics as A
from orderflow.operators.weekly_rollup import WeeklyRollup
from orderflow.sources import quarantine as QR
from orderflow.sources import schemas as S
from orderflow.streaming import streams as ST
from orderflow.streaming.weekly import WeeklyStream

ARCHIVE = "id long, archived_at timestamp_ntz, drink string, temperature string, milk string, syrups string"


def orders(n, seed=0, start=dt.datetime(2024, 2, 26), hours=6):
    r = random.Random(seed)
    return [(i, start + dt.timedelta(hours=hours * i, minutes=r.randrange(60)), r.choice(["Latte", "Tea", "Mocha", "", None]),
             r.choice(["Hot", "cold", "Iced"]), r.choice(["Oat", " ", None]), r.choice(["A , B", "B", "", None])) for i in range(n)]


def table(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_rollup_equals_recomputation_after_append_and_delete(spark, scratch):
    rows = orders(300)
    random.Random(1).shuffle(rows)
    gone = [x for x in rows if x[0] % 7 == 0 or dt.datetime(2024, 3, 18) < x[1] < dt.datetime(2024, 4, 9)]
    left = [x for x in rows if x not in gone]
    df = lambda x: spark.createDataFrame(x, ARCHIVE)
    r = WeeklyRollup(spark, f"{scratch}/rollup", buckets=4)
    assert r.trend() is None
    assert r.change(added=df(rows[:120]), batch=0)
    assert r.change(added=df(rows[120:]), batch=1)
    assert not r.change(added=df(rows[120:]), batch=1)                     # a repeated batch does nothing
    assert r.change(removed=df(gone), source="clear")
    assert r.change(added=df([]), batch=2)
    assert table(r.trend()) == table(A.with_empty_weeks(A.weekly_trend(df(left))))
    weeks = r.trend().orderBy("week_start").collect()
    assert any(w.total_orders == 0 and w.top_drinks == [] for w in weeks)
    assert all(x.week_end == y.week_start for x, y in zip(weeks, weeks[1:]))   # no gap, the clock change included
    assert sum(w.total_orders for w in weeks) == len(left)
    with pytest.raises(Exception, match="never counted"):
        r.change(removed=df(gone), source="clear", batch=1)
    assert sum(w.total_orders for w in r.trend().collect()) == len(left)   # the failed change published nothing


def test_trend_reads_the_archive_once(spark):
    df = spark.createDataFrame(orders(50), ARCHIVE)
    plan = A.weekly_trend(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_closed_weeks_leave_the_state_and_late_rows_are_kept(spark, scratch):
    rows = orders(200, seed=3)
    cut = [rows[:80], rows[80:140], rows[3:6] + rows[140:150] + [(999, None, "Tea", "Hot", None, None)], rows[150:] + rows[90:92]]
    w = WeeklyStream(spark, f"{scratch}/weekly", delay=dt.timedelta(hours=2), buckets=3)
    assert w.closed() is None and w.late() is None
    sizes, sent = [], []
    for part in cut:
        spark.createDataFrame(part, ARCHIVE).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        w.start(ST.stream_changes(spark, f"{scratch}/in", spark.createDataFrame([], ARCHIVE).schema), f"{scratch}/ck").awaitTermination()
        sent += part
        counts = {n: sum(r.cnt for r in d.filter("dim = 'total'").collect()) for n, d in (("closed", w.closed()), ("open", w.open()))}
        assert counts["closed"] + counts["open"] + w.late().count() == len(sent)      # nothing is lost or doubled
        sizes.append(w.open().select("week_start").distinct().count())
    assert max(sizes) <= 2 and w.open().join(w.closed(), "week_start", "semi").count() == 0
    assert sorted(r.id for r in w.late().collect()) == [3, 4, 5, 90, 91, 999]
    on_time = [r for r in sent if r not in rows[3:6] and r not in rows[90:92] and r[1]] + rows[3:6] + rows[90:92]
    want = A.weekly_counts(spark.createDataFrame(on_time, ARCHIVE))
    assert table(w.closed().unionByName(w.open())) == table(want.select("week_start", "dim", "item", "cnt"))
    before = table(w.closed())
    w._batch(spark.createDataFrame(rows[:80], ARCHIVE), 0)                            # a replayed batch
    assert table(w.closed()) == before


def test_a_failed_batch_publishes_nothing(spark, scratch, monkeypatch):
    rows = orders(120, seed=5)
    w = WeeklyStream(spark, f"{scratch}/weekly", buckets=2)
    w._batch(spark.createDataFrame(rows[:60], ARCHIVE), 0)
    closed, still = table(w.closed()), table(w.open())
    with monkeypatch.context() as m:
        m.setattr(w.state, "replace", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w._batch(spark.createDataFrame(rows[60:], ARCHIVE), 1)
    assert (table(w.closed()), table(w.open())) == (closed, still)
    w._batch(spark.createDataFrame(rows[60:], ARCHIVE), 1)
    assert table(w.closed().unionByName(w.open())) == table(A.weekly_counts(spark.createDataFrame(rows, ARCHIVE)).select("week_start", "dim", "item", "cnt"))


def test_a_batch_keeps_counts_only_and_cuts_at_the_weeks_of_the_shop(spark, scratch, monkeypatch):
    """the rows of a batch are not held; late is what lies before the watermark's own week, clock changes included."""
    held, persist = [], type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: held.append(self.columns) or persist(self, *a))
    rows = orders(60, seed=9)
    for n, day in enumerate((dt.datetime(2024, 3, 11), dt.datetime(2024, 11, 4))):   # Mondays after a clock change
        w = WeeklyStream(spark, f"{scratch}/w{n}", delay=dt.timedelta(0), buckets=2)
        times = [day + dt.timedelta(hours=h, microseconds=u) for h in (-200, -168, 0, 6, 7, 8, 9) for u in (-1, 0)]
        for mark in (day + dt.timedelta(hours=7), day + dt.timedelta(hours=8)):
            first = w.state.state()[0] + 1
            w._batch(spark.createDataFrame([(*rows[0][:1], mark, *rows[0][2:])], ARCHIVE), first)
            assert w.watermark() == mark
            batch = spark.createDataFrame([(i, t, *rows[0][2:]) for i, t in enumerate(times) if t <= mark], ARCHIVE)
            want = batch.withColumn("week_start", X.week_start("archived_at")).filter(w._ended(mark)).count()
            before = w.late().count()
            w._batch(batch, first + 1)
            assert w.late().count() - before == want
    assert held and not any("id" in c for c in held)


LINES = [('{"id":"1","item":"Oat","type":"milk","available":true,"active":false,"sort_order":3}', None), ('{"id":"2","item":"Soy","extra":[1]}', None),
         ("", "blank"), (" \t ", "blank"), (None, "blank"), ('{"id":"3","item"', "malformed"), ("plain", "malformed"),
         ('{"id":"4","item":null}', "missing: item"), ('{}', "missing: id, item"), ('{"id":"5","item":"x","sort_order":"a","available":"b"}', "type: available, sort_order"),
         ('{"id":"1","item":"Oat","type":"milk","available":true,"active":false,"sort_order":3}', None)]


def test_good_and_bad_rows_sum_to_the_input(spark, scratch):
    df = spark.createDataFrame([(t,) for t, _ in LINES], "value string")
    rows = QR.checked(df, S.INVENTORY, required=("id", "item"))
    assert [r.reason for r in rows.collect()] == [why for _, why in LINES]
    assert QR.good(rows).schema == S.INVENTORY and QR.good(rows).count() + QR.bad(rows).count() == len(LINES)
    assert QR.good(QR.checked(df.filter("false"), S.INVENTORY)).count() == 0
    df.filter("value is not null").write.text(f"{scratch}/in")
    for _ in range(2):                                                     # the second run finds nothing new
        QR.stream_checked(spark.readStream.text(f"{scratch}/in"), S.INVENTORY, f"{scratch}/out", f"{scratch}/ck", required=("id", "item")).awaitTermination()
    got = spark.read.parquet(f"{scratch}/out/bad")
    assert sorted((r.raw, r.reason) for r in got.collect()) == sorted((t, why) for t, why in LINES if why and t is not None)
    assert spark.read.parquet(f"{scratch}/out/good").count() == 3


def test_csv_rows_by_schema(spark):
    df = spark.createDataFrame([("4,milk,true",), ("x,milk,true",), (",,",), ("7,oat,false",)], "value string")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ok", T.BooleanType())])
    rows = QR.checked(df, schema, "csv", required=("kind",)).collect()
    assert [r.reason for r in rows] == [None, "type: n", "missing: kind", None] and rows[3].row.n == 7
