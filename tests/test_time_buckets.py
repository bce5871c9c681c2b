import datetime as dt

from orderflow.operators import notify as N
from orderflow.sources import sinks
from orderflow.sources.time_buckets import TimeBuckets

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def test_retention_drops_days_and_rewrites_only_the_one_it_cuts(spark, scratch):
    rows = [(i, T0 + i * 6 * HOUR) for i in range(40)] + [(100, None)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp_ntz")
    table = TimeBuckets(spark, f"{scratch}/t")
    table.load(df)
    before = table.state()[1]
    as_of = T0 + dt.timedelta(days=35, hours=12)                 # the limit of 30 days cuts 6 January at noon
    assert N.retention_commit(table, as_of, 30) == 22
    kept, _ = N.retention_job(df, as_of, 30)
    assert sorted(r.id for r in table.read().collect()) == sorted(r.id for r in kept.collect())
    after = table.state()[1]
    assert {d for d in after if after[d] != before[d]} == {"2024-01-06"}
    assert set(before) - set(after) == {f"2024-01-0{d}" for d in range(1, 6)}
    versions = sinks.versions(spark, f"{scratch}/t")
    assert N.retention_commit(table, as_of, 30) == 0 and sinks.versions(spark, f"{scratch}/t") == versions
    assert N.retention_commit(table, as_of + dt.timedelta(days=900), None) == 18 and [r.id for r in table.read().collect()] == [100]


def test_a_failed_retention_leaves_the_table(spark, scratch, monkeypatch):
    import pytest
    table = TimeBuckets(spark, f"{scratch}/t")
    table.load(spark.createDataFrame([(1, T0), (2, T0 + 30 * HOUR)], "id int, created_at timestamp_ntz"))
    with monkeypatch.context() as m:
        m.setattr(sinks, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.retain(T0 + 26 * HOUR)
    assert sorted(r.id for r in table.read().collect()) == [1, 2]
    assert table.retain(T0 + 26 * HOUR) == 1 and [r.id for r in table.read().collect()] == [2]
