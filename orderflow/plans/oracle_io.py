"""DuckDB oracle SQL for the source/sink round trips and stream fan-out."""

from __future__ import annotations

from .oracle import QUEUE, SQL
from .oracle_events import SC, SUBS

SQL["order_grid_roundtrip"] = f"""
WITH {QUEUE.strip()}
SELECT status, id LIKE '%7' AS blank_id, count(*) AS cnt FROM queue GROUP BY 1, 2
"""

SQL["inventory_grid_roundtrip"] = """
SELECT p_brand || ' ' || p_name AS item, CASE WHEN p_size % 3 = 0 THEN 'milk' ELSE 'syrup' END AS type,
       p_size % 4 <> 0 AS available, count(*) AS cnt
FROM part WHERE p_size % 13 <> 0 AND p_size % 3 IN (0, 1)
GROUP BY 1, 2, 3
"""

SQL["append_and_snapshot"] = f"""
WITH {QUEUE.strip()}
SELECT CAST(year(created_at) AS INTEGER) AS year, count(*) AS orders,
       (SELECT count(*) FROM part WHERE p_partkey % 10 <> 0) AS catalogue_rows
FROM queue GROUP BY 1
"""

SQL["json_rows"] = """
SELECT CAST(to_json({'id': CAST(p_partkey AS VARCHAR), 'item': p_name, 'available': p_size % 4 <> 0,
                     'active': p_partkey % 10 <> 0, 'sort_order': p_size}) AS VARCHAR) AS json
FROM part
"""

SQL["stream_announce"] = f"""
WITH {SC.strip()},
lagged AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev_status FROM sc)
SELECT order_id, ts, seq, status FROM lagged
WHERE status IN ('ready', 'complete') AND NOT coalesce(prev_status IN ('ready', 'complete'), false)
ORDER BY ts DESC, seq DESC LIMIT 1
"""

SQL["stream_notify_payloads"] = f"""
WITH {SC.strip()},
lagged AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev_status FROM sc),
edges AS (SELECT order_id, seq FROM lagged
          WHERE status = 'complete' AND NOT coalesce(prev_status IN ('ready', 'complete'), false)),
{SUBS.strip()}
SELECT s.endpoint, s.order_id,
       s.customer_name || ', your order is ready. Please go to the kitchen. Order: ' || s.order_name AS body,
       '/?order=' || s.order_id AS url
FROM edges e JOIN subs s ON s.order_id = e.order_id
"""

SQL["stream_upsert_subscriptions"] = f"""
WITH {SUBS.strip()}
SELECT endpoint, id, order_id, order_name, created_at, updated_at FROM subs
"""
