"""DuckDB oracle SQL for the change streams with bucketed state."""

from __future__ import annotations

from .oracle import QUEUE, SQL
from .oracle_events import SC, TARGETS

SQL["stream_first_ready_rows"] = SQL["first_ready"]

_LANDING = """(CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-15' THEN 1
                WHEN ts < TIMESTAMP '2024-01-23' THEN 2 ELSE 3 END)"""

SQL["stream_announcements"] = f"""
WITH {QUEUE.strip()}, {SC.strip()},
first AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, seq) AS rn FROM sc WHERE status IN ('ready', 'complete')),
new AS (SELECT f.order_id, f.ts, f.seq, f.status, q.created_at,
               row_number() OVER (PARTITION BY {_LANDING} ORDER BY q.created_at DESC NULLS LAST, f.order_id DESC) AS place
        FROM first f LEFT JOIN queue q ON q.id = f.order_id WHERE f.rn = 1)
SELECT order_id, ts, seq, status, created_at FROM new WHERE place = 1
"""

# a success and a vanished endpoint get one message; a failure one in every landing with an edge of its order
SQL["stream_delivery"] = f"""
WITH {TARGETS.strip()},
landings AS (SELECT order_id, count(DISTINCT {_LANDING}) AS n FROM edges GROUP BY 1)
SELECT s.endpoint, s.id, s.order_id,
       CASE WHEN l.n IS NULL THEN 0 WHEN s.seq % 4 = 3 THEN l.n ELSE 1 END AS messages, t.body,
       l.n IS NULL OR s.seq % 4 = 3 AS kept
FROM subs s LEFT JOIN landings l USING (order_id) LEFT JOIN targets t ON t.id = s.id
"""
