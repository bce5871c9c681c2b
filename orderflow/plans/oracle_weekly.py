"""DuckDB oracle SQL for stored and streamed weekly counts and for quarantined rows."""

from __future__ import annotations

from .oracle import MEASURES, SQL, TZ, local_week, tally


def _tally_of(where: str) -> str:
    return tally({"week_start": local_week("archived_at")}).strip().replace("FROM archive\n)", f"FROM archive WHERE {where}\n)")


SQL["weekly_rollup"] = f"""
WITH {_tally_of("NOT (archived_at >= TIMESTAMP '1995-02-01 00:00:00' AND archived_at < TIMESTAMP '1995-03-20 00:00:00')")},
spine AS (
  SELECT timezone('UTC', timezone('{TZ}', w)) AS week_start, timezone('UTC', timezone('{TZ}', w + INTERVAL 7 DAY)) AS week_end
  FROM (SELECT min(timezone('{TZ}', timezone('UTC', week_start))) AS lo, max(timezone('{TZ}', timezone('UTC', week_start))) AS hi FROM best),
       unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS t(w)
)
SELECT spine.week_start AS week_start, any_value(spine.week_end) AS week_end,
       {MEASURES}
FROM spine LEFT JOIN best ON spine.week_start = best.week_start GROUP BY spine.week_start
"""

_LATE = "(split_part(id, '-', 2) = '7' AND archived_at < TIMESTAMP '1996-01-01 00:00:00')"

SQL["stream_weekly_closed"] = f"""
WITH {_tally_of("NOT " + _LATE)},
mark AS (SELECT max(archived_at) - INTERVAL 2 HOUR AS t FROM archive)
SELECT CASE WHEN timezone('UTC', timezone('{TZ}', timezone('{TZ}', timezone('UTC', week_start)) + INTERVAL 7 DAY)) <= t
            THEN 'closed' ELSE 'open' END AS state,
       week_start, CASE kind WHEN 'order' THEN 'total' ELSE kind END AS dim, item, cnt
FROM best, mark
UNION ALL
SELECT 'late', {local_week("archived_at")}, 'total', '*', count(*) FROM archive WHERE {_LATE} GROUP BY 2
"""

SQL["quarantined_rows"] = """
WITH lines AS (
  SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'malformed' WHEN p_partkey % 13 = 0 THEN 'blank'
                 WHEN p_partkey % 17 = 0 THEN 'missing: item' WHEN p_partkey % 19 = 0 THEN 'type: sort_order'
                 WHEN p_partkey % 23 = 0 THEN 'type: available' ELSE '' END AS reason
  FROM part
)
SELECT how, CASE WHEN reason = '' THEN 'good' ELSE 'bad' END AS kind, reason,
       CASE WHEN reason = '' THEN p_name END AS item, CASE WHEN reason = '' THEN true END AS available,
       CASE WHEN reason = '' THEN CAST(p_size AS INTEGER) END AS sort_order, count(*) AS rows
FROM lines, (VALUES ('batch'), ('stream')) AS m(how) GROUP BY ALL
"""
