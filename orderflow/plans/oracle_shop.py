"""DuckDB oracle SQL for closed-shop paths, composed moves, whole reports and counters."""

from __future__ import annotations

from .oracle import ARCHIVE, EVENTS_AS_OF, QUEUE, SQL
from .oracle_catalog import DOC_LINES, REINDEXED
from .oracle_events import SUBS
from .oracle_queue import _first_word

SQL["clear_all_closed"] = f"""
WITH {QUEUE.strip()}
SELECT status, count(*) AS archived, CAST(0 AS BIGINT) AS remaining FROM queue GROUP BY status
"""

SQL["archive_commits"] = f"""
WITH {QUEUE.strip()}
SELECT id, 1 AS move, CASE WHEN status = 'complete' THEN 'archive' ELSE 'queue' END AS place, CAST(1 AS BIGINT) AS rows FROM queue
UNION ALL SELECT id, 2, 'archive', 1 FROM queue
"""

SQL["place_orders_closed"] = f"""
WITH {QUEUE.strip()}
SELECT id, 'Queue closed' AS reason FROM queue WHERE created_at >= TIMESTAMP '2001-06-01 00:00:00'
"""

SQL["display_head"] = f"""
WITH {QUEUE.strip()},
strip AS (SELECT created_at, id, {_first_word("customer_name")} AS n FROM queue WHERE status IN ('ready', 'complete')
          ORDER BY created_at DESC, id DESC LIMIT 4)
SELECT false AS is_open,
       (SELECT trim(arg_max(props, (ts, event_id)), '"') FROM events WHERE event_type = 'purchase') AS message,
       (SELECT string_agg(n, ' · ' ORDER BY created_at DESC, id DESC) FROM strip) AS pickup_names
"""

SQL["order_counts"] = f"""
WITH {QUEUE.strip()}
SELECT count(*) AS orders, count(*) FILTER (WHERE status <> 'complete') AS active_orders FROM queue
"""

SQL["orders_by_status"] = f"WITH {QUEUE.strip()}\nSELECT id, status FROM queue WHERE status IN ('ready', 'making')"

SQL["active_orders_list"] = f"WITH {QUEUE.strip()}\nSELECT id, created_at, status FROM queue WHERE status <> 'complete'"

SQL["weekly_summary_empty"] = """
SELECT 0 AS week_offset, TIMESTAMP '2010-05-31 07:00:00' AS week_start, TIMESTAMP '2010-06-07 07:00:00' AS week_end,
       CAST(0 AS BIGINT) AS total_orders, CAST(0 AS BIGINT) AS hot_orders, CAST(0 AS BIGINT) AS cold_orders,
       '' AS top_drinks, '' AS top_milks, '' AS top_syrups
"""

SQL["clear_archive"] = f"WITH {ARCHIVE.strip()}\nSELECT count(*) AS removed, CAST(0 AS BIGINT) AS kept FROM archive"

SQL["archive_order_data"] = f"""
WITH {QUEUE.strip()}
SELECT id AS original_order_id_text, id AS data_id, status AS data_status, drink AS data_drink, customer_name AS data_customer_name,
       CAST(shop_id AS VARCHAR) AS data_shop_id
FROM queue WHERE status = 'complete'
"""


def _moved(src: str, out: str, f: str, t: str) -> str:
    """One move of every list of ``src`` from place f to place t (SQL over columns of the list's row)."""
    return f"""
{out} AS (
  SELECT s.type, s.id, CASE WHEN f IS NULL OR t IS NULL OR f = t OR t < 0 THEN p WHEN p = f THEN t WHEN f < p AND p <= t THEN p - 1
                            WHEN t <= p AND p < f THEN p + 1 ELSE p END AS p
  FROM {src} s LEFT JOIN (SELECT n.type, ({f.format(src=src)}) AS f, ({t.format(src=src)}) AS t FROM names n) m ON m.type = s.type)"""


_PLACE = "SELECT x.p FROM {{src}} x WHERE x.type = n.type AND x.id = n.{0}"
SQL["moves_composed"] = f"""
WITH {REINDEXED.strip()},
names AS (SELECT type, min(id) AS a, max(id) AS z, min(CASE WHEN p = 1 THEN id END) AS b FROM r GROUP BY type),
{_moved("r", "r1", _PLACE.format("a"), _PLACE.format("z"))},
{_moved("r1", "r2", _PLACE.format("b"), _PLACE.format("a"))},
{_moved("r2", "r3", _PLACE.format("z"), _PLACE.format("z").replace("x.p", "x.p - 1"))}
SELECT type, id, CAST(p AS INTEGER) AS sort_order FROM r3
"""

SQL["save_menu_strict"] = f"""
WITH {DOC_LINES.strip()},
flags AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE p_size % 4 = 0) AS off, count(DISTINCT p_brand) AS brands FROM lines GROUP BY 1),
milks AS (SELECT doc_id, p_brand AS item, p_size % 4 <> 0 AS available FROM lines),
words AS (SELECT DISTINCT doc_id, unnest(string_split(p_name, ' ')) AS item FROM lines),
every AS (SELECT doc_id, item, available FROM milks UNION ALL SELECT doc_id, item, true FROM words),
-- a member that is no list brings no items, so it has no doubled ones either
d AS (SELECT r.doc_id, r.doc_id % 10 NOT IN (2, 3) AS doc_ok,
             CASE WHEN r.doc_id % 10 IN (2, 3) THEN 0 ELSE r.duplicate_items END AS duplicate_items,
             CASE WHEN r.doc_id % 10 = 1 THEN f.off ELSE 0 END AS bad_flags
      FROM report r JOIN flags f USING (doc_id)),
n AS (SELECT doc_id, count(*) AS ingredients, count(*) FILTER (WHERE available) AS in_stock FROM every GROUP BY 1)
SELECT d.*, doc_ok AND duplicate_items = 0 AND bad_flags = 0 AS saved,
       CASE WHEN doc_ok AND duplicate_items = 0 AND bad_flags = 0 THEN n.ingredients ELSE 0 END AS ingredients,
       CASE WHEN doc_ok AND duplicate_items = 0 AND bad_flags = 0 THEN n.in_stock ELSE 0 END AS in_stock
FROM d JOIN n USING (doc_id)
"""

SQL["clamped_limits"] = """
SELECT p_partkey, CAST(greatest(1, least(CASE WHEN p_size % 7 <> 0 THEN p_size * 3 - 20 ELSE 25 END, 50)) AS BIGINT) AS rows FROM part
"""

SQL["tables_read"] = "SELECT p_type, count(*) AS parts FROM part GROUP BY p_type"

SQL["retention_commits"] = f"""
WITH {SUBS.strip()},
x AS (SELECT endpoint, created_at, coalesce(created_at < {EVENTS_AS_OF} - INTERVAL 28 DAY, false) AS first,
             coalesce(created_at < {EVENTS_AS_OF} - INTERVAL 20 DAY, false) AS second FROM subs)
SELECT endpoint, created_at, (SELECT count(*) FROM x WHERE first) AS removed_0, (SELECT count(*) FROM x WHERE second AND NOT first) AS removed_1,
       CAST(0 AS BIGINT) AS removed_2
FROM x WHERE NOT second
"""
