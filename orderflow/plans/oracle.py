"""Independent DuckDB SQL for every registered query.

Written by hand against the driver's views (region, nation, customer,
supplier, part, orders, lineitem, events, ...); nothing here is generated
from the Spark code.  Zone arithmetic uses DuckDB's timezone(): a naive
UTC value goes timezone('UTC', x) -> instant -> timezone(tz, .) -> local
wall clock, and back the same way.
"""

from __future__ import annotations

SQL: dict = {}

TZ = "America/Los_Angeles"
ARCHIVE_AS_OF = "TIMESTAMP '1998-06-17 20:00:00'"
QUEUE_AS_OF = "TIMESTAMP '1998-08-02 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# ------------------------------------------------------------------ views
ARCHIVE = """
archive AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         l_shipdate AS archived_at,
         CAST(l_orderkey AS VARCHAR) AS original_order_id,
         'Supplier ' || CAST(l_suppkey AS VARCHAR) AS customer_name,
         p_type AS drink,
         CASE WHEN l_linestatus = 'F' THEN 'Hot' ELSE 'COLD' END AS temperature,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS milk,
         CASE WHEN p_size % 7 = 0 THEN '' ELSE replace(p_name, ' ', ' , ') END AS syrups,
         '' AS notes, 'complete' AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

QUEUE = """
queue AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         o_orderdate AS created_at,
         c_name AS customer_name,
         o_orderpriority AS drink,
         CASE WHEN o_totalprice >= 100000 THEN 'Hot' ELSE 'Cold' END AS temperature,
         '' AS milk, '' AS notes,
         CASE WHEN o_orderstatus = 'O' THEN 'waiting'
              WHEN o_orderstatus = 'P' THEN 'making'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'ready'
              WHEN o_orderstatus = 'F' THEN 'complete' END AS status,
         c_nationkey AS shop_id,
         o_custkey AS customer_key
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def local_week(ts: str, shift: str = "0") -> str:
    """UTC naive ts -> UTC naive start of its local week (+shift weeks)."""
    return (f"timezone('UTC', timezone('{TZ}', date_trunc('week', timezone('{TZ}', timezone('UTC', {ts})))"
            f" + to_weeks({shift})))")


def tally(keys: dict[str, str]) -> str:
    """CTEs up to ``best``: how often each item of each kind occurs per key, ranked.
    Every archived order gives one tall list of (kind, item): itself, its
    temperature, drink and milk, and each of its comma-separated syrups."""
    named = "".join(f"{sql} AS {name}, " for name, sql in keys.items())
    names = "".join(f"{name}, " for name in keys)
    return f"""
{ARCHIVE.strip()},
tall AS (
  SELECT {named}unnest(list_concat(
           [{{'kind': 'order', 'item': '*'}}, {{'kind': 'temp', 'item': lower(temperature)}},
            {{'kind': 'drink', 'item': drink}}, {{'kind': 'milk', 'item': milk}}],
           list_transform(string_split(coalesce(syrups, ''), ','), lambda x: {{'kind': 'syrup', 'item': x}}))) AS e
  FROM archive
),
best AS (
  SELECT {names}e.kind AS kind, trim(e.item) AS item, count(*) AS cnt,
         row_number() OVER (PARTITION BY {names}e.kind ORDER BY count(*) DESC, trim(e.item)) AS rnk
  FROM tall WHERE trim(e.item) <> ''
  GROUP BY {names}e.kind, trim(e.item)
)"""


def _n(kind: str, item: str, name: str) -> str:
    return f"CAST(coalesce(sum(cnt) FILTER (WHERE kind = '{kind}' AND item = '{item}'), 0) AS BIGINT) AS {name}"


def _top(kind: str) -> str:
    return (f"coalesce(string_agg(item || '=' || cnt, '; ' ORDER BY rnk) FILTER (WHERE kind = '{kind}' AND rnk <= 5), '')"
            f" AS top_{kind}s")


MEASURES = ",\n       ".join([_n("order", "*", "total_orders"), _n("temp", "hot", "hot_orders"), _n("temp", "cold", "cold_orders"),
                             _top("drink"), _top("milk"), _top("syrup")])


def _week(offset: int) -> str:
    """One row for the week ``offset`` weeks from the current one, even an empty week."""
    start = local_week(ARCHIVE_AS_OF, str(offset))
    return f"""
WITH {tally({"week_start": local_week("archived_at")}).strip()}
SELECT CAST({offset} AS INTEGER) AS week_offset, {start} AS week_start,
       {local_week(ARCHIVE_AS_OF, str(offset + 1))} AS week_end,
       {MEASURES}
FROM best WHERE week_start = {start}
"""


SQL["weekly_summary"] = _week(0)
SQL["weekly_summary_prev"] = _week(-3)

SQL["weekly_trend"] = f"""
WITH {tally({"week_start": local_week("archived_at")}).strip()}
SELECT week_start,
       timezone('UTC', timezone('{TZ}', timezone('{TZ}', timezone('UTC', week_start)) + INTERVAL 7 DAY)) AS week_end,
       {MEASURES}
FROM best GROUP BY week_start
"""

SQL["weekly_top_by_temp"] = f"""
WITH {tally({"shop": "trim(temperature)", "week_start": local_week("archived_at")}).strip()}
SELECT shop, week_start, kind AS dim, rnk, item, cnt FROM best
WHERE kind IN ('drink', 'milk', 'syrup') AND rnk <= 5
"""

SQL["drink_popularity"] = f"""
WITH {ARCHIVE.strip()}
SELECT nullif(trim(drink), '') AS item, count(*) AS cnt FROM archive
WHERE nullif(trim(drink), '') IS NOT NULL GROUP BY 1
"""
