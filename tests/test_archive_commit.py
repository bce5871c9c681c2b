import datetime as dt

import pytest

from orderflow.operators.archive_commit import ShopLedger
from orderflow.sources import sinks

T0 = dt.datetime(2024, 1, 1)


def orders(spark):
    rows = [(f"o{i}", T0 + dt.timedelta(days=i), "Ann Lee", "tea", "Hot", "", ["A"], "", st) for i, st in enumerate(
        ["complete", "waiting", "complete", "making", "ready"])]
    return spark.createDataFrame(rows, "id string, created_at timestamp_ntz, customer_name string, drink string, temperature string, "
                                       "milk string, syrups array<string>, notes string, status string")


def ids(ledger):
    queue, archive = ledger.read()
    return sorted(r.id for r in queue.collect()), sorted(r.original_order_id for r in archive.collect()) if archive is not None else []


def settings(spark, flag):
    return spark.createDataFrame([("isOpen", flag)], "key string, value string")


def test_moves_add_up_and_repeat_as_no_ops(spark, scratch):
    ledger = ShopLedger(spark, f"{scratch}/shop")
    ledger.load(orders(spark))
    assert ids(ledger) == ([f"o{i}" for i in range(5)], [])
    assert ledger.clear_completed(T0)
    assert ids(ledger) == (["o1", "o3", "o4"], ["o0", "o2"])
    assert not ledger.clear_completed(T0) and ids(ledger) == (["o1", "o3", "o4"], ["o0", "o2"])
    before = ids(ledger)
    assert not ledger.clear_all(settings(spark, "true"), T0) and ids(ledger) == before     # open: nothing moves
    assert ledger.clear_all(settings(spark, '"false"'), T0)
    assert ids(ledger) == ([], [f"o{i}" for i in range(5)])


@pytest.mark.parametrize("step", ["queue", "archive", "publish"])
def test_a_crash_at_any_step_leaves_both_as_they_were(spark, scratch, monkeypatch, step):
    ledger = ShopLedger(spark, f"{scratch}/shop")
    ledger.load(orders(spark))
    aside = ShopLedger._aside

    def fail(self, df, name, number):
        path = aside(self, df, name, number)
        if name == step:
            raise RuntimeError("crash")
        return path

    def stop(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(ShopLedger, "_aside", fail)
        if step == "publish":
            m.setattr(sinks, "publish", stop)
        with pytest.raises(RuntimeError):
            ledger.clear_completed(T0)
    assert ids(ledger) == ([f"o{i}" for i in range(5)], [])
    assert ledger.clear_completed(T0)
    assert ids(ledger) == (["o1", "o3", "o4"], ["o0", "o2"])
