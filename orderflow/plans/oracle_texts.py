"""DuckDB oracle SQL for the scalar-function and stream queries."""

from __future__ import annotations

from .oracle import ARCHIVE, QUEUE, SQL, TZ, local_week, tally
from .oracle_events import SC

SQL["order_texts"] = f"""
WITH {QUEUE.strip()},
a AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS position,
             greatest(0, (epoch_us(TIMESTAMP '1998-08-02 00:00:00') - epoch_us(created_at)) // 60000000) AS m,
             replace(customer_name, '#', ' ') AS nm
      FROM queue WHERE status <> 'complete')
SELECT id,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min ago'
       WHEN m % 60 = 0 THEN CAST(m // 60 AS VARCHAR) || ' hr ago'
       ELSE CAST(m // 60 AS VARCHAR) || ' hr ' || CAST(m % 60 AS VARCHAR) || ' min ago' END AS age,
  printf('%03d', position) AS ticket,
  CASE WHEN greatest(0, position - 1) = 0 THEN 'You''re up next'
       ELSE 'Estimated wait: ~' || CAST(greatest(0, position - 1) * 4 AS VARCHAR) || ' min' END AS wait,
  greatest(0, position - 1) * 4 AS wait_minutes,
  CASE WHEN greatest(0, position - 1) = 0 THEN 'No orders ahead of you.'
       WHEN position - 1 = 1 THEN '1 order ahead of you.'
       ELSE CAST(position - 1 AS VARCHAR) || ' orders ahead of you.' END AS ahead,
  CASE status WHEN 'making' THEN 'Being made' WHEN 'ready' THEN 'Ready for pickup'
              WHEN 'complete' THEN 'Ready for pickup' ELSE 'Waiting' END AS label,
  coalesce(nullif(string_split_regex(trim(nm), '\\s+')[1], ''), 'Guest') AS first_name,
  CASE WHEN trim(nm) = '' THEN 0 ELSE len(string_split_regex(trim(nm), '\\s+')) END AS words,
  coalesce(nullif(CASE WHEN position % 2 = 0 THEN position END, 0), greatest(0, position - 1) + 1) AS position_fixed,
  coalesce(status IN ('making', 'ready', 'complete'), false) AS step_making,
  coalesce(status IN ('ready', 'complete'), false) AS step_ready
FROM a
"""

SQL["catalogue_texts"] = """
WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, ' ' || p_brand || '!' AS raw,
                  (['on', ' Yes', '0', 'OFF', 'bad', NULL])[p_size % 6 + 1] AS flag FROM part)
SELECT p_partkey,
  regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug_client,
  lower(regexp_replace(raw, '[^a-zA-Z0-9]+', '-', 'g')) AS slug_sql,
  trim('"' || p_name || '"', '"') AS unquoted,
  left(p_name, 5) AS clipped,
  CASE WHEN lower(trim(flag)) IN ('t', 'true', 'y', 'yes', 'on', '1') THEN true
       WHEN lower(trim(flag)) IN ('f', 'false', 'n', 'no', 'off', '0') THEN false ELSE true END AS flag,
  coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_brand END), ''), 'Milk') AS milk
FROM p
"""

SQL["list_texts"] = """
WITH p AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN '' ELSE replace(p_name, ' ', ' , ') END AS syr,
                  string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey,
  array_to_string(regexp_split_to_array(syr, '\\s*,\\s*'), ', ') AS syrups_text,
  len(regexp_split_to_array(syr, '\\s*,\\s*')) AS n_items,
  concat_ws(' · ', 'Hot', p_type, nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END, ''),
            array_to_string(w, ', ')) AS summary,
  CASE WHEN w[1] IN ('red', 'small', 'blue', 'new') THEN w[1]
       WHEN w[2] IN ('red', 'small', 'blue', 'new') THEN w[2] ELSE '' END AS capped,
  CASE p_size % 3 WHEN 0 THEN 'Hot,Cold' WHEN 1 THEN 'Hot' ELSE 'Cold' END AS temps,
  CASE p_size % 3 WHEN 0 THEN 'Cold,Hot' WHEN 1 THEN 'Warm' ELSE 'Cold' END AS distinct_temps
FROM p
"""

_CUR = local_week("TIMESTAMP '1998-06-17 20:00:00'")
SQL["week_texts"] = f"""
WITH {ARCHIVE.strip()},
w AS (SELECT DISTINCT {local_week("archived_at")} AS week_start FROM archive),
x AS (SELECT week_start, {local_week("week_start", "1")} AS week_end,
             date_diff('day', CAST(timezone('{TZ}', timezone('UTC', {_CUR})) AS DATE),
                              CAST(timezone('{TZ}', timezone('UTC', week_start)) AS DATE)) // 7 AS n
      FROM w)
SELECT week_start, week_end, n AS "offset",
  CASE WHEN n = 0 THEN 'This week' WHEN n = -1 THEN 'Last week'
       ELSE CAST(abs(n) AS VARCHAR) || ' week' || CASE WHEN abs(n) = 1 THEN '' ELSE 's' END
            || CASE WHEN n < 0 THEN ' ago' ELSE ' ahead' END END AS label,
  strftime(timezone('{TZ}', timezone('UTC', week_start)), '%b %-d') || ' - ' ||
  strftime(CAST(timezone('{TZ}', timezone('UTC', week_end)) AS DATE) - INTERVAL 1 DAY, '%b %-d') AS range_text
FROM x
"""

SQL["json_texts"] = """
SELECT event_id, json_extract_string(props, '$.k') AS k,
       CAST(to_json({'event_id': event_id, 'event_type': event_type}) AS VARCHAR) AS row_json
FROM events
"""

SQL["stream_ready_edges"] = SQL["ready_edges"]

SQL["stream_first_ready"] = f"""
WITH {SC.strip()}
SELECT DISTINCT order_id FROM sc WHERE status IN ('ready', 'complete')
"""

SQL["stream_weekly_top"] = f"""
WITH {tally({"week_start": local_week("archived_at")}).strip()}
SELECT week_start, kind AS dim, rnk, item, cnt FROM best
WHERE kind IN ('drink', 'milk', 'syrup') AND rnk <= 5
"""

SQL["syrup_items"] = f"""
WITH {ARCHIVE.strip()}
SELECT id, syrup FROM (
  SELECT id, nullif(trim(s), '') AS syrup
  FROM archive, unnest(regexp_split_to_array(coalesce(nullif(trim(syrups), ''), ''), '\\s*,\\s*')) AS t(s))
WHERE syrup IS NOT NULL
"""
