"""Driver contract: entry runs, every query has a schema, oracle names agree,
and a sample of queries matches its oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, digest

SMOKE = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and "top_drinks" in df.columns


def test_registry_covers_oracle():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


@pytest.mark.parametrize("name", ["weekly_trend", "fifo_position_by_shop", "validate_orders", "ready_edges",
                                  "notify_payloads", "move_item", "order_texts", "update_status"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    sdf = E.queries()[name](spark, SMOKE)
    a = digest(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(E.oracle_sql()[name])
    b = digest([d[0] for d in cur.description], cur.fetchall())
    assert a[:3] == b[:3]
