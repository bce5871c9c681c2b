"""DuckDB oracle SQL for the events queries."""

from __future__ import annotations

from .oracle import EVENTS_AS_OF, QUEUE, SQL

SC = """
sc AS (
  SELECT CAST(user_id AS VARCHAR) AS order_id, ts, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'waiting' WHEN 'click' THEN 'making'
                         WHEN 'signup' THEN 'ready' WHEN 'purchase' THEN 'complete' END AS status
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')
)"""

SUBS = """
su AS (
  SELECT 'sub-' || CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS order_id,
         'ep-' || CAST(user_id AS VARCHAR) || '-' || event_type AS endpoint,
         'User ' || CAST(user_id AS VARCHAR) AS customer_name, event_type AS order_name,
         ts AS created_at, ts AS updated_at, event_id AS seq
  FROM events
),
subs AS (
  SELECT l.endpoint, f.id, l.order_id, l.customer_name, l.order_name, f.created_at, l.updated_at, l.seq
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY updated_at DESC, seq DESC) AS rn
                       FROM su) WHERE rn = 1) l
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY updated_at, seq) AS rn
                       FROM su) WHERE rn = 1) f USING (endpoint)
)"""

EDGES = f"""
{SC.strip()},
lagged AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev_status FROM sc),
edges AS (SELECT order_id, ts, seq, status, prev_status FROM lagged
          WHERE status = 'complete' AND NOT coalesce(prev_status IN ('ready', 'complete'), false))"""

SETTINGS_LAST = """
sl AS (SELECT event_type AS key, props AS value, ts, event_id AS seq FROM events),
settings AS (SELECT key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM sl) WHERE rn = 1)"""

# fixed values: the notification texts
TARGETS = f"""
{EDGES.strip()},
{SUBS.strip()},
targets AS (
  SELECT s.*, 'Order ready' AS title,
         CASE WHEN coalesce(trim(s.customer_name), '') <> ''
              THEN trim(s.customer_name) || ', your order is ready. Please go to the kitchen.'
              ELSE 'Your order is ready. Please go to the kitchen.' END
         || CASE WHEN coalesce(trim(s.order_name), '') <> '' THEN ' Order: ' || trim(s.order_name) ELSE '' END AS body,
         '/?order=' || s.order_id AS url
  FROM (SELECT DISTINCT order_id FROM edges) e JOIN subs s ON s.order_id = e.order_id
),
outcomes AS (SELECT id, endpoint, [201, 404, 410, 500][CAST(seq % 4 + 1 AS INTEGER)] AS status_code FROM targets)"""

SQL["ready_edges"] = f"WITH {EDGES.strip()}\nSELECT * FROM edges"

SQL["ready_edges_display"] = f"""
WITH {SC.strip()},
lagged AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev_status FROM sc)
SELECT order_id, ts, seq, status, prev_status FROM lagged
WHERE status IN ('ready', 'complete') AND NOT coalesce(prev_status IN ('ready', 'complete'), false)
"""

SQL["first_ready"] = f"""
WITH {SC.strip()}
SELECT order_id, ts, seq, status FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, seq) AS rn
  FROM sc WHERE status IN ('ready', 'complete')) WHERE rn = 1
"""

SQL["latest_subscriptions"] = f"""
WITH {SUBS.strip()}
SELECT endpoint, id, order_id, order_name, created_at, updated_at FROM subs
"""

SQL["notify_payloads"] = f"WITH {TARGETS.strip()}\nSELECT endpoint, order_id, title, body, url FROM targets"

SQL["delivery_summary"] = f"""
WITH {TARGETS.strip()}
SELECT count(*) FILTER (WHERE status_code >= 200 AND status_code < 300) AS sent,
       count(*) FILTER (WHERE (status_code >= 200 AND status_code < 300) OR status_code IN (404, 410)) AS removed
FROM outcomes
"""

SQL["settle_kept"] = f"""
WITH {TARGETS.strip()}
SELECT endpoint, id, order_id FROM subs
WHERE id NOT IN (SELECT id FROM outcomes WHERE status_code >= 200 AND status_code < 300)
  AND endpoint NOT IN (SELECT endpoint FROM outcomes WHERE status_code IN (404, 410))
"""

SQL["retention_kept"] = f"""
WITH {SUBS.strip()}
SELECT endpoint, created_at FROM subs
WHERE NOT coalesce(created_at < {EVENTS_AS_OF} - INTERVAL 28 DAY, false)
"""

SQL["retention_removed"] = f"""
WITH {SUBS.strip()}
SELECT count(*) FILTER (WHERE created_at < {EVENTS_AS_OF} - INTERVAL 28 DAY) AS removed,
       count(*) FILTER (WHERE created_at < {EVENTS_AS_OF} - INTERVAL 1 DAY) AS removed_min_day
FROM subs
"""

SQL["settings_current"] = f"WITH {SETTINGS_LAST.strip()}\nSELECT key, trim(value, '\"') AS value FROM settings"

SQL["status_report"] = f"""
WITH {SETTINGS_LAST.strip()}
SELECT coalesce(max(CASE WHEN key = 'isOpen' THEN trim(value, '"') END), 'true') = 'true' AS is_open,
       coalesce(max(CASE WHEN key = 'message' THEN trim(value, '"') END), '') AS message,
       json_extract_string(coalesce(max(CASE WHEN key = 'click' THEN trim(value, '"') END), ''), '$.k') AS click_k
FROM settings
"""

SQL["update_settings"] = """
WITH sl AS (SELECT event_type AS key, props AS value, ts, event_id AS seq FROM events),
base AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn
                                 FROM sl WHERE ts < TIMESTAMP '2024-01-15 00:00:00') WHERE rn = 1),
later AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn
                                  FROM sl WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND value IS NOT NULL)
          WHERE rn = 1)
SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM later)
UNION ALL SELECT key, value FROM later
"""

SQL["update_status"] = f"""
WITH {QUEUE.strip()}, {SC.strip()},
ch AS (SELECT order_id, lower(status) AS status FROM (
         SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC) AS rn FROM sc
         WHERE lower(status) IN ('waiting', 'making', 'ready', 'complete')) WHERE rn = 1),
snap AS (SELECT q.id, q.created_at, CASE WHEN ch.order_id IS NOT NULL THEN ch.status ELSE q.status END AS status
         FROM queue q LEFT JOIN ch ON ch.order_id = q.id)
SELECT id, status, row_number() OVER (ORDER BY created_at, id) AS position FROM snap WHERE status <> 'complete'
"""

SQL["status_delta"] = f"""
WITH {QUEUE.strip()}, {SC.strip()},
cur AS (SELECT id, status FROM queue WHERE status <> 'complete'),
d AS (SELECT order_id AS id, status FROM (
        SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC) AS rn FROM sc) WHERE rn = 1),
merged AS (SELECT * FROM cur WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT * FROM d)
SELECT id, status FROM merged WHERE coalesce(status, '') <> 'complete'
"""

SQL["unseen_ready"] = f"""
WITH {SC.strip()},
ch AS (SELECT * FROM sc WHERE status IN ('ready', 'complete'))
SELECT order_id AS id, seq FROM ch
WHERE ts >= TIMESTAMP '2024-01-03 00:00:00'
  AND order_id NOT IN (SELECT order_id FROM ch WHERE ts < TIMESTAMP '2024-01-03 00:00:00')
"""
