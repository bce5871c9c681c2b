"""DuckDB oracle SQL for the queue/archive queries."""

from __future__ import annotations

from .oracle import ARCHIVE, QUEUE, QUEUE_AS_OF, SQL

EVENTS_SETTINGS = """
settings AS (
  SELECT key, value FROM (
    SELECT event_type AS key, props AS value,
           row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1
)"""


def _first_word(c: str) -> str:
    return f"coalesce(nullif(string_split(regexp_replace(trim({c}), '\\s+', ' ', 'g'), ' ')[1], ''), 'Guest')"


SQL["fifo_position"] = f"""
WITH {QUEUE.strip()}
SELECT id, created_at, status, row_number() OVER (ORDER BY created_at, id) AS position,
       greatest(0, row_number() OVER (ORDER BY created_at, id) - 1) AS orders_ahead
FROM queue WHERE status <> 'complete'
"""

SQL["fifo_position_by_shop"] = f"""
WITH {QUEUE.strip()}
SELECT shop_id, id, row_number() OVER (PARTITION BY shop_id ORDER BY created_at, id) AS position
FROM queue WHERE status <> 'complete'
"""

SQL["board_by_shop"] = f"""
WITH {QUEUE.strip()},
b AS (SELECT *, row_number() OVER (PARTITION BY shop_id
          ORDER BY CASE WHEN status = 'making' THEN 0 ELSE 1 END, created_at, id) AS position
      FROM queue WHERE status IN ('waiting', 'making'))
SELECT shop_id, id, status, position,
       CASE WHEN status = 'making' THEN 'Now'
            WHEN position - 1 <= 0 THEN 'You''re up next'
            ELSE '~' || CAST((position - 1) * 4 AS VARCHAR) || ' min' END AS wait,
       {_first_word("customer_name")} AS first_name,
       temperature || ' ' || drink AS order_text
FROM b WHERE position <= 14
"""

SQL["board_position"] = f"""
WITH {QUEUE.strip()}
SELECT id, status, row_number() OVER (ORDER BY CASE WHEN status = 'making' THEN 0 ELSE 1 END, created_at, id) AS position
FROM queue WHERE status IN ('waiting', 'making')
"""

SQL["orders_report"] = f"""
WITH {QUEUE.strip()},
a AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS position FROM queue WHERE status <> 'complete')
SELECT id, created_at AS time, coalesce(customer_name, '') AS name, drink, coalesce(temperature, '') AS temp,
       coalesce(milk, '') AS milk, '' AS syrups, coalesce(notes, '') AS notes,
       coalesce(status, 'waiting') AS status, position, greatest(0, position - 1) AS orders_ahead
FROM a
"""

SQL["ready_strip"] = f"""
WITH {QUEUE.strip()}
SELECT id, created_at, status, {_first_word("customer_name")} AS first_name, drink, temperature
FROM queue WHERE status IN ('ready', 'complete')
ORDER BY created_at DESC, id DESC LIMIT 8
"""

SQL["order_status"] = f"""
WITH {QUEUE.strip()},
req AS (SELECT DISTINCT requested_id FROM (
          SELECT id AS requested_id FROM queue
          UNION ALL SELECT 'x' || CAST(c_custkey AS VARCHAR) FROM customer)),
ranked AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM queue WHERE status <> 'complete')
SELECT r.requested_id, q.id IS NOT NULL AS found,
       CASE WHEN q.id IS NOT NULL THEN coalesce(q.status, 'waiting') END AS status,
       k.position, CASE WHEN k.position IS NULL THEN NULL ELSE greatest(0, k.position - 1) END AS orders_ahead,
       CASE WHEN q.id IS NOT NULL THEN coalesce(q.customer_name, '') END AS name, q.drink,
       CASE WHEN q.id IS NOT NULL THEN coalesce(q.temperature, '') END AS temp
FROM req r
LEFT JOIN (SELECT * FROM queue WHERE status IS NOT NULL) q ON q.id = r.requested_id
LEFT JOIN ranked k ON k.id = r.requested_id
"""

SQL["archive_completed"] = f"""
WITH {QUEUE.strip()}
SELECT sha256(id || '|' || strftime({QUEUE_AS_OF}, '%Y-%m-%d %H:%M:%S.%f')) AS id,
       {QUEUE_AS_OF} AS archived_at,
       id AS original_order_id, created_at AS original_created_at,
       coalesce(customer_name, '') AS customer_name, drink, coalesce(temperature, '') AS temperature,
       milk, '' AS syrups, notes, status
FROM queue WHERE status = 'complete'
"""

SQL["archive_remaining"] = f"""
WITH {QUEUE.strip()}
SELECT id, status FROM queue WHERE NOT coalesce(status = 'complete', false)
"""

SQL["clear_all_guard"] = f"""
WITH {QUEUE.strip()}, {EVENTS_SETTINGS.strip()},
open AS (SELECT coalesce(max(CASE WHEN key = 'isOpen' THEN trim(value, '"') END), 'true') = 'true' AS is_open
         FROM settings)
SELECT count(*) FILTER (WHERE NOT (SELECT is_open FROM open)) AS archived,
       count(*) FILTER (WHERE (SELECT is_open FROM open)) AS remaining
FROM queue
"""

SQL["recent_archive"] = f"""
WITH {ARCHIVE.strip()}
SELECT id, archived_at, original_order_id, archived_at AS time,
       coalesce(customer_name, '') AS name, coalesce(drink, '') AS drink, coalesce(temperature, '') AS temp,
       coalesce(milk, '') AS milk, coalesce(syrups, '') AS syrups, coalesce(notes, '') AS notes,
       coalesce(status, '') AS status
FROM archive ORDER BY archived_at DESC, id DESC LIMIT 25
"""

SQL["delete_week"] = f"""
WITH {ARCHIVE.strip()}
SELECT count(*) FILTER (WHERE archived_at >= TIMESTAMP '1998-06-15 07:00:00'
                          AND archived_at < TIMESTAMP '1998-06-22 07:00:00') AS removed,
       count(*) FILTER (WHERE NOT (archived_at >= TIMESTAMP '1998-06-15 07:00:00'
                          AND archived_at < TIMESTAMP '1998-06-22 07:00:00')) AS kept
FROM archive
"""

SQL["place_orders"] = f"""
WITH {QUEUE.strip()},
ledger AS (SELECT id, created_at, status FROM queue WHERE created_at < TIMESTAMP '2001-06-01 00:00:00'
           UNION ALL
           SELECT id, created_at, 'waiting' FROM queue WHERE created_at >= TIMESTAMP '2001-06-01 00:00:00'),
ranked AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM ledger WHERE status <> 'complete')
SELECT n.id, r.position, greatest(0, r.position - 1) AS orders_ahead
FROM (SELECT id FROM queue WHERE created_at >= TIMESTAMP '2001-06-01 00:00:00') n
LEFT JOIN ranked r ON r.id = n.id
"""

SQL["lookup_orders"] = f"""
WITH {QUEUE.strip()},
req AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS requested_id FROM lineitem)
SELECT r.requested_id, q.status, q.created_at FROM req r LEFT JOIN queue q ON q.id = r.requested_id
"""

SQL["status_domain"] = """
WITH raw AS (SELECT CASE WHEN event_type = 'signup' THEN 'READY' WHEN event_type = 'view' THEN 'Waiting'
                         ELSE event_type END AS status FROM events)
SELECT status, coalesce(lower(status) IN ('waiting', 'making', 'ready', 'complete'), false) AS valid,
       count(*) AS cnt
FROM raw GROUP BY 1, 2
"""

SQL["archive_report_max"] = f"""
WITH {ARCHIVE.strip()}
SELECT id, archived_at, original_order_id, archived_at AS time,
       coalesce(customer_name, '') AS name, coalesce(drink, '') AS drink, coalesce(temperature, '') AS temp,
       coalesce(milk, '') AS milk, coalesce(syrups, '') AS syrups, coalesce(notes, '') AS notes,
       coalesce(status, '') AS status
FROM archive ORDER BY archived_at DESC, id DESC LIMIT 50
"""

# the rank index gives what the full ranking gives
SQL["order_status_indexed"] = SQL["order_status"]
SQL["place_orders_indexed"] = SQL["place_orders"]
