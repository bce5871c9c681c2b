"""DuckDB oracle SQL for the catalogue queries."""

from __future__ import annotations

from .oracle import QUEUE, SQL

INVENTORY = """
inventory AS (
  SELECT 'milk:' || item AS id, item, 'milk' AS type, n % 4 <> 0 AS available, n % 10 <> 0 AS active,
         n AS sort_order
  FROM (SELECT DISTINCT p_brand AS item, CAST(substr(p_brand, 7, 10) AS INTEGER) AS n FROM part)
  UNION ALL
  SELECT 'syrup:' || item, item, 'syrup', length(item) % 3 <> 0, item <> 'gear', 0
  FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS item FROM part)
)"""

MENU = """
menu AS (
  SELECT lower(p_type) AS id, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS label,
         CASE WHEN length(p_type) % 2 = 0 THEN ['Hot', 'Cold'] WHEN length(p_type) = 7 THEN ['Cold']
              ELSE ['Hot'] END AS temps,
         length(p_type) % 3 <> 0 AS has_milk, p_type <> 'LARGE' AS has_syrups, true AS show_temp,
         p_type <> 'PROMO' AS active, CAST(length(p_type) AS INTEGER) AS sort_order
  FROM (SELECT DISTINCT p_type FROM part)
)"""

CATALOGUE = """
catalogue AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS item, p_type AS type, p_size % 4 <> 0 AS available,
         p_partkey % 10 <> 0 AS active, p_size AS sort_order
  FROM part
)"""

# fixed values: the default ingredient list (syrups, then milks)
DEFAULTS = """
defaults AS (
  SELECT * FROM (VALUES
    ('Caramel', 'syrup', true, 0), ('Sugar Free Caramel', 'syrup', true, 1), ('Vanilla', 'syrup', true, 2),
    ('Sugar Free Vanilla', 'syrup', true, 3), ('Mocha', 'syrup', true, 4), ('White Chocolate', 'syrup', true, 5),
    ('Honey', 'syrup', true, 6), ('Cinnamon Powder', 'syrup', true, 7), ('Hazelnut', 'syrup', true, 8),
    ('Whole milk', 'milk', true, 0), ('Almond milk', 'milk', true, 1), ('Oat milk', 'milk', true, 2),
    ('Soy milk', 'milk', true, 3)) AS t(item, type, available, sort_order)
)"""

STOCK = f"""
{INVENTORY.strip()},
{DEFAULTS.strip()},
inv_active AS (SELECT item, type, coalesce(available, true) AS available, sort_order FROM inventory
               WHERE coalesce(active, true) AND type IN ('syrup', 'milk')),
stock_rows AS (SELECT * FROM inv_active
               UNION ALL
               SELECT item, type, available, sort_order FROM defaults d
               WHERE NOT EXISTS (SELECT 1 FROM inv_active a WHERE a.type = d.type)),
stock AS (SELECT item, available AS in_stock FROM (
            SELECT item, available, row_number() OVER (PARTITION BY item
                ORDER BY CASE WHEN type = 'milk' THEN 1 ELSE 0 END DESC, sort_order DESC, item DESC) AS rn
            FROM stock_rows) WHERE rn = 1)"""

LAST_ORDER = f"""
{QUEUE.strip()},
last AS (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY customer_key ORDER BY created_at DESC, id DESC) AS rn
                        FROM queue q) WHERE rn = 1),
firstline AS (SELECT l_orderkey, l_partkey FROM (
                SELECT l_orderkey, l_partkey,
                       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
                FROM lineitem) WHERE rn = 1),
lo AS (
  SELECT CAST(customer_key AS VARCHAR) AS id,
         CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN c_name
              ELSE replace(c_name, '#', ' ') END AS customer_name,
         CASE WHEN p_size % 9 = 0 THEN 'retired-' || lower(p_type) ELSE lower(p_type) END AS drink_id,
         upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS drink_label,
         temperature AS temp,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS milk,
         string_split(p_name, ' ') AS syrups,
         created_at + INTERVAL 30 DAY AS expires_at
  FROM last JOIN firstline ON last.id = CAST(firstline.l_orderkey AS VARCHAR)
       JOIN part ON l_partkey = p_partkey
       JOIN customer ON customer_key = c_custkey
)"""

SQL["stock_table"] = f"WITH {STOCK.strip()}\nSELECT item, in_stock FROM stock"

SQL["inventory_report"] = f"""
WITH {INVENTORY.strip()}
SELECT type, row_number() OVER (PARTITION BY type ORDER BY sort_order, item) - 1 AS idx,
       lower(regexp_replace(item, '[^a-zA-Z0-9]+', '-', 'g')) AS id, item, available, active, sort_order
FROM inventory WHERE active = true AND type IN ('syrup', 'milk')
"""

SQL["menu_report"] = f"""
WITH {MENU.strip()}
SELECT row_number() OVER (ORDER BY sort_order, label) - 1 AS idx, id, label, array_to_string(temps, ',') AS temps,
       has_milk, has_syrups, sort_order
FROM menu WHERE active = true
"""

SQL["catalog_counts"] = f"""
WITH {CATALOGUE.strip()}
SELECT type, count(*) AS rows, count(*) FILTER (WHERE coalesce(active, false)) AS active_rows
FROM catalogue GROUP BY type
"""

# fixed values: the seed preference order used by the rank backfill
SQL["backfill_rank"] = f"""
WITH {INVENTORY.strip()}
SELECT type, item,
       CAST(CASE WHEN sort_order = 0 THEN row_number() OVER (PARTITION BY type ORDER BY
         CASE item WHEN 'Whole milk' THEN 0 WHEN 'Almond milk' THEN 1 WHEN 'Oat milk' THEN 2 WHEN 'Soy milk' THEN 3
                   WHEN 'Caramel' THEN 0 WHEN 'Sugar Free Caramel' THEN 1 WHEN 'Vanilla' THEN 2
                   WHEN 'Sugar Free Vanilla' THEN 3 WHEN 'Mocha' THEN 4 WHEN 'White Chocolate' THEN 5
                   WHEN 'Honey' THEN 6 WHEN 'Cinnamon Powder' THEN 7 WHEN 'Hazelnut' THEN 8 ELSE 99 END,
         item) - 1 ELSE sort_order END AS INTEGER) AS sort_order
FROM inventory
"""

REINDEXED = f"""
{CATALOGUE.strip()},
r AS (SELECT type, id, CAST(row_number() OVER (PARTITION BY type ORDER BY sort_order, item, id) - 1 AS INTEGER) AS p
      FROM catalogue)"""

SQL["reindex_catalogue"] = f"WITH {REINDEXED.strip()}\nSELECT type, id, p AS sort_order FROM r"

SQL["move_item"] = f"""
WITH {REINDEXED.strip()},
mv AS (SELECT type, min(id) AS from_id, max(id) AS to_id FROM catalogue GROUP BY type),
pos AS (SELECT mv.type, f.p AS fp, t.p AS tp FROM mv
        JOIN r f ON f.type = mv.type AND f.id = mv.from_id
        JOIN r t ON t.type = mv.type AND t.id = mv.to_id
        WHERE mv.from_id <> mv.to_id)
SELECT r.type, r.id,
       CAST(CASE WHEN pos.fp IS NULL THEN r.p
                 WHEN r.p = pos.fp THEN pos.tp
                 WHEN pos.fp < r.p AND r.p <= pos.tp THEN r.p - 1
                 WHEN pos.tp <= r.p AND r.p < pos.fp THEN r.p + 1
                 ELSE r.p END AS INTEGER) AS sort_order
FROM r LEFT JOIN pos ON pos.type = r.type
"""

SQL["swap_neighbour"] = f"""
WITH {REINDEXED.strip()},
mv AS (SELECT type, max(id) AS from_id FROM catalogue GROUP BY type),
n AS (SELECT type, count(*) AS n FROM r GROUP BY type),
pos AS (SELECT mv.type, f.p AS fp, f.p - 1 AS tp FROM mv
        JOIN r f ON f.type = mv.type AND f.id = mv.from_id JOIN n ON n.type = mv.type
        WHERE f.p - 1 >= 0 AND f.p - 1 < n.n)
SELECT r.type, r.id,
       CAST(CASE WHEN r.p = pos.fp THEN pos.tp WHEN r.p = pos.tp THEN pos.fp ELSE r.p END AS INTEGER) AS sort_order
FROM r LEFT JOIN pos ON pos.type = r.type
"""

SQL["duplicate_names"] = f"""
WITH {CATALOGUE.strip()}
SELECT item, count(*) AS cnt FROM catalogue GROUP BY item HAVING count(*) > 1
"""

SQL["catalog_check"] = f"""
WITH {MENU.strip()}, {INVENTORY.strip()}
SELECT (SELECT count(*) FILTER (WHERE coalesce(active, false)) FROM menu) AS active_drinks,
       (SELECT count(*) FILTER (WHERE type = 'milk') FROM inventory) AS milk_rows,
       (SELECT count(*) FILTER (WHERE type = 'syrup') FROM inventory) AS syrup_rows,
       (SELECT count(*) FILTER (WHERE coalesce(active, false)) FROM menu) > 0
         AND (SELECT count(*) FILTER (WHERE type = 'milk') FROM inventory) > 0
         AND (SELECT count(*) FILTER (WHERE type = 'syrup') FROM inventory) > 0 AS ok
"""

SQL["validate_orders"] = f"""
WITH {LAST_ORDER.strip()}, {MENU.strip()}, {STOCK.strip()},
vis AS (SELECT * FROM menu WHERE coalesce(active, true)),
firstdrink AS (SELECT has_milk FROM vis ORDER BY sort_order, label LIMIT 1),
syr AS (SELECT id, unnest(syrups) AS s, unnest(range(len(syrups))) AS pos FROM lo),
bad AS (SELECT syr.id, arg_min(syr.s, syr.pos) AS s FROM syr LEFT JOIN stock ON stock.item = syr.s
        WHERE NOT coalesce(stock.in_stock, false) GROUP BY syr.id),
v AS (
  SELECT lo.id,
    CASE WHEN vis.id IS NULL THEN 'That drink is not available today' END AS error_drink,
    CASE WHEN trim(coalesce(lo.customer_name, '')) = '' THEN 'Please enter your name'
         WHEN len(string_split_regex(trim(lo.customer_name), '\\s+')) < 2
           THEN 'Please enter first and last name' END AS error_name,
    CASE WHEN coalesce(lo.milk, '') <> '' AND NOT coalesce(ms.in_stock, false) THEN lo.milk || ' is out of stock'
         WHEN coalesce(vis.has_milk, (SELECT has_milk FROM firstdrink), true) AND coalesce(lo.milk, '') = ''
           THEN 'Please choose a milk' END AS error_milk,
    CASE WHEN bad.s IS NOT NULL THEN bad.s || ' is out of stock' END AS error_syrups
  FROM lo LEFT JOIN vis ON vis.id = lo.drink_id
          LEFT JOIN stock ms ON ms.item = lo.milk
          LEFT JOIN bad ON bad.id = lo.id)
SELECT *, error_drink IS NULL AND error_name IS NULL AND error_milk IS NULL AND error_syrups IS NULL AS valid FROM v
"""

SQL["propose_reorder"] = f"""
WITH {LAST_ORDER.strip()}, {MENU.strip()}, {STOCK.strip()},
src AS (SELECT * FROM lo WHERE expires_at IS NULL OR TIMESTAMP '2001-07-01 00:00:00' <= expires_at),
vis AS (SELECT * FROM menu WHERE coalesce(active, true)),
by_label AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY sort_order, label) AS rn
                            FROM vis) WHERE rn = 1),
m AS (SELECT src.*, coalesce(i.id, l.id) AS m_id,
             CASE WHEN i.id IS NOT NULL THEN i.temps ELSE l.temps END AS m_temps,
             CASE WHEN i.id IS NOT NULL THEN i.has_milk ELSE l.has_milk END AS m_has_milk,
             CASE WHEN i.id IS NOT NULL THEN i.has_syrups ELSE l.has_syrups END AS m_has_syrups
      FROM src LEFT JOIN vis i ON i.id = src.drink_id
               LEFT JOIN by_label l ON lower(src.drink_label) = lower(l.label)),
syr AS (SELECT id, unnest(syrups) AS s, unnest(range(len(syrups))) AS pos FROM src),
ok AS (SELECT syr.id, string_agg(syr.s, ',' ORDER BY syr.pos) FILTER (WHERE syr.pos >= 0) AS lst,
              list(syr.s ORDER BY syr.pos) AS arr
       FROM syr JOIN stock ON stock.item = syr.s WHERE stock.in_stock GROUP BY syr.id)
SELECT m.id, m.m_id IS NOT NULL AS matched,
       m.m_id AS next_drink_id,
       CASE WHEN m.m_id IS NOT NULL THEN
         CASE WHEN coalesce(list_contains(m.m_temps, m.temp), false) THEN m.temp ELSE m.m_temps[1] END END AS next_temp,
       CASE WHEN m.m_id IS NOT NULL THEN
         CASE WHEN m.m_has_milk AND coalesce(ms.in_stock, false) THEN m.milk ELSE '' END END AS next_milk,
       CASE WHEN m.m_id IS NOT NULL THEN
         CASE WHEN m.m_has_syrups AND m.syrups IS NOT NULL THEN array_to_string(coalesce(ok.arr, [])[1:2], ',')
              ELSE '' END END AS next_syrups,
       CASE WHEN m.m_id IS NULL THEN 'That saved drink is not on today''s menu.' END AS error
FROM m LEFT JOIN stock ms ON ms.item = m.milk LEFT JOIN ok ON ok.id = m.id
"""

SQL["update_inventory"] = f"""
WITH {INVENTORY.strip()},
ch AS (SELECT p_brand AS item, max(p_size) % 2 = 0 AS available FROM part GROUP BY p_brand
       UNION ALL SELECT DISTINCT p_type, false FROM part)
SELECT i.item, i.type, CASE WHEN ch.item IS NOT NULL THEN ch.available ELSE i.available END AS available
FROM inventory i LEFT JOIN ch ON ch.item = i.item
UNION ALL
SELECT ch.item, 'missing', ch.available FROM ch WHERE ch.item NOT IN (SELECT item FROM inventory)
"""

SQL["insert_absent"] = f"""
WITH {INVENTORY.strip()}, {DEFAULTS.strip()}
SELECT item, type, available FROM inventory
UNION ALL
SELECT item, type, available FROM defaults WHERE item NOT IN (SELECT item FROM inventory)
"""

DOC_LINES = """
lines AS (
  SELECT l_orderkey AS doc_id, p_name, p_brand, p_type, p_size,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
drinks AS (
  SELECT doc_id, CASE WHEN p_size % 6 = 0 THEN 'drink-' || CAST(pos AS VARCHAR) ELSE lower(p_type) END AS id,
         p_name AS label, CASE WHEN p_size % 2 = 0 THEN 'Hot,Cold' ELSE 'Hot' END AS temps,
         p_size % 3 <> 0 AS has_milk, p_size % 5 <> 0 AS active, CAST(pos AS INTEGER) AS sort_order
  FROM lines
),
last_drinks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY sort_order DESC) AS rn
                               FROM drinks) WHERE rn = 1),
items AS (SELECT doc_id, p_brand AS item FROM lines
          UNION ALL
          SELECT DISTINCT doc_id, unnest(string_split(p_name, ' ')) FROM lines),
dups AS (SELECT doc_id, count(*) AS duplicate_items FROM (
           SELECT doc_id, item FROM items GROUP BY doc_id, item HAVING count(*) > 1) GROUP BY doc_id),
report AS (SELECT d.doc_id, true AS doc_ok, coalesce(dups.duplicate_items, 0) AS duplicate_items,
                  coalesce(dups.duplicate_items, 0) = 0 AS saved
           FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN dups USING (doc_id))"""

SQL["save_menu_report"] = f"WITH {DOC_LINES.strip()}\nSELECT doc_id, doc_ok, duplicate_items, saved FROM report"

SQL["ingest_menu_drinks"] = f"""
WITH {DOC_LINES.strip()}
SELECT d.doc_id, d.id, d.label, d.temps, d.has_milk, d.active, d.sort_order
FROM last_drinks d JOIN report r ON r.doc_id = d.doc_id WHERE r.saved
"""

SQL["in_stock_items"] = f"""
WITH {INVENTORY.strip()}
SELECT item, type FROM inventory
WHERE type IN ('syrup', 'milk') AND coalesce(available, true) AND coalesce(active, true)
"""

SQL["order_lines_list"] = """
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts
FROM lineitem GROUP BY l_orderkey
"""

SQL["normalized_menu"] = f"""
WITH {MENU.strip()}
SELECT CASE WHEN id = 'small' THEN 'drink' ELSE id END AS id,
       CASE WHEN id = 'small' THEN 'Drink' ELSE label END AS label,
       CASE WHEN id = 'medium' THEN 'Cold' WHEN id = 'large' THEN 'Hot' ELSE array_to_string(temps, ',') END AS temps,
       coalesce(has_milk, false) AS has_milk, true AS show_temp, active, sort_order
FROM menu
"""

SQL["enrich_orders"] = f"""
WITH {LAST_ORDER.strip()}, {MENU.strip()}, {STOCK.strip()},
vis AS (SELECT * FROM menu WHERE coalesce(active, true)),
syr AS (SELECT id, unnest(syrups) AS s, unnest(range(len(syrups))) AS pos FROM lo),
sj AS (SELECT syr.id, syr.s, syr.pos, coalesce(stock.in_stock, false) AS ok
       FROM syr LEFT JOIN stock ON stock.item = syr.s),
agg AS (SELECT id, arg_min(s, pos) FILTER (WHERE NOT ok) AS bad,
               coalesce(string_agg(s, ',' ORDER BY pos) FILTER (WHERE ok), '') AS good
        FROM sj GROUP BY id)
SELECT lo.id, vis.id AS m_id, vis.has_milk AS m_has_milk, coalesce(ms.in_stock, false) AS milk_in_stock,
       agg.bad AS first_out_of_stock_syrup, coalesce(agg.good, '') AS in_stock_syrups
FROM lo LEFT JOIN vis ON vis.id = lo.drink_id
        LEFT JOIN stock ms ON ms.item = lo.milk
        LEFT JOIN agg ON agg.id = lo.id
"""

SQL["required_fields"] = f"""
WITH {LAST_ORDER.strip()}
SELECT coalesce(trim(customer_name) <> '', false) AND coalesce(trim(milk) <> '', false) AS valid, count(*) AS cnt
FROM lo GROUP BY 1
"""

QUEUE_ORDERS = f"""
{QUEUE.strip()},
lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
lo AS (
  SELECT concat_ws('-', queue.id, l_linenumber, l_partkey, l_suppkey) AS id,
         CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN c_name
              ELSE replace(c_name, '#', ' ') END AS customer_name,
         CASE WHEN p_size % 9 = 0 THEN 'retired-' || lower(p_type) ELSE lower(p_type) END AS drink_id,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS milk,
         string_split(p_name, ' ') AS syrups
  FROM queue LEFT JOIN lines ON queue.id = CAST(l_orderkey AS VARCHAR)
       LEFT JOIN part ON l_partkey = p_partkey
       JOIN customer ON customer_key = c_custkey
)"""

for _last, _all in (("validate_orders", "validate_queue_orders"), ("enrich_orders", "enrich_queue_orders"),
                    ("required_fields", "required_queue_fields")):
    SQL[_all] = SQL[_last].replace(LAST_ORDER.strip(), QUEUE_ORDERS.strip())
