"""Independent SQL statements of every registered query, for DuckDB.

Written separately from the DataFrame code so that agreement means
something. Views ``lineitem part supplier documents embeddings ...`` are
registered by the caller. Shared CTEs are composed by name.
"""
from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *deps: str):
    def wrap(sql: str):
        CTES[name] = (deps, sql.strip())
        return sql
    return wrap


cte("qi")("""
SELECT p_brand AS rfq_id, s_suppkey AS quote_seq, s_name AS supplier_name,
       l_orderkey * 8 + l_linenumber AS item_pos, p_name AS item_name,
       l_quantity AS quantity, 'pcs' AS unit,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL
            ELSE floor(l_extendedprice / l_quantity * 100) / 100 END AS unit_price,
       CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linenumber = 7 THEN l_extendedprice + 0.004
            ELSE l_extendedprice END AS total_price,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE p_type END AS portion,
       CASE WHEN l_discount = 0 THEN NULL ELSE 'Box of ' || CAST(p_size AS VARCHAR) END AS packaging
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""")

cte("items", "qi")("""
SELECT rfq_id, quote_seq, item_pos, item_name,
       CASE WHEN supplier_name IS NULL OR supplier_name = '' THEN 'Unknown Supplier'
            ELSE supplier_name END AS supplier_name,
       quantity, unit, unit_price,
       coalesce(total_price, round(quantity * unit_price, 2)) AS total_price,
       portion, packaging
FROM qi
""")

cte("quotes")("""
SELECT DISTINCT p_brand AS rfq_id, s_suppkey AS quote_seq, s_name AS supplier_name,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'FOB' END AS delivery_terms,
       CAST(s_nationkey AS INTEGER) AS delivery_lead_time_days,
       CASE s_suppkey % 4
            WHEN 0 THEN CAST(10 + (s_suppkey % 5) * 10 AS VARCHAR) || '% advance, balance on delivery'
            WHEN 1 THEN 'Net 30'
            WHEN 3 THEN '100% Upfront' END AS payment_terms,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '6 months' END AS warranty
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""")

cte("req_items")("""
SELECT DISTINCT p_brand AS rfq_id, p_name AS item_name FROM part
""")

cte("rfq")("""
SELECT rfq_id, 'RFQ-' || replace(rfq_id, '#', '-') AS rfq_ref,
       CASE WHEN n % 5 = 0 THEN NULL
            ELSE '2026-' || lpad(CAST(n % 12 + 1 AS VARCHAR), 2, '0') || '-'
                 || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') END AS deadline_date
FROM (SELECT DISTINCT p_brand AS rfq_id,
             CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS n FROM part)
""")

cte("totals", "items")("""
SELECT rfq_id, supplier_name, CAST(round(sum(CAST(total_price AS DECIMAL(30,8))), 2) AS DOUBLE) AS total_quoted_cost
FROM items GROUP BY rfq_id, supplier_name
""")

cte("cost_rank", "totals")("""
SELECT rfq_id, supplier_name, total_quoted_cost,
       round(total_quoted_cost - min(total_quoted_cost) OVER (PARTITION BY rfq_id), 2)
           AS savings_vs_cheapest,
       CASE WHEN total_quoted_cost IS NOT NULL THEN
           CAST(rank() OVER (PARTITION BY rfq_id ORDER BY total_quoted_cost ASC NULLS LAST)
                AS INTEGER) END AS rank
FROM totals
""")


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


SQL: dict[str, str] = {}


def sql(name: str, *ctes: str):
    def wrap(body: str):
        SQL[name] = with_ctes(body, *ctes)
        return body
    return wrap


sql("item_comparison", "items")("""
SELECT rfq_id, quote_seq, item_pos, item_name, supplier_name, quantity, unit, unit_price,
       total_price, portion, packaging FROM items
""")

sql("total_cost_rank", "cost_rank")("SELECT * FROM cost_rank")

sql("price_matrix", "items")("""
SELECT rfq_id, item_name, supplier_name,
       arg_min(unit_price, {'q': quote_seq, 'p': item_pos}) AS unit_price
FROM items WHERE unit_price IS NOT NULL AND item_name IS NOT NULL
GROUP BY rfq_id, item_name, supplier_name
""")

_cell = "arg_min(unit_price, {{'q': quote_seq, 'p': item_pos}}) FILTER (WHERE {}) AS nation_{}".format
sql("price_pivot", "items")(f"""
SELECT rfq_id, item_name, {', '.join(_cell(f's_nationkey = {n}', n) for n in range(25))},
       {_cell('s_nationkey IS NULL OR s_nationkey NOT BETWEEN 0 AND 24', 'other')}
FROM items JOIN supplier ON s_suppkey = quote_seq
WHERE unit_price IS NOT NULL AND item_name IS NOT NULL GROUP BY rfq_id, item_name
""")

sql("cheapest_per_item", "items")("""
SELECT rfq_id, item_name, supplier_name AS best_price_supplier, unit_price AS best_unit_price,
       quantity, total_price
FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id, item_name
                 ORDER BY unit_price, quote_seq, item_pos, supplier_name, quantity,
                          total_price NULLS FIRST) AS rn
      FROM items WHERE unit_price IS NOT NULL AND item_name IS NOT NULL)
WHERE rn = 1
""")

cte("req_keys", "req_items")(r"""
SELECT DISTINCT rfq_id, lower(regexp_replace(item_name, '^\s+|\s+$', '', 'g')) AS item_key
FROM req_items WHERE item_name IS NOT NULL AND item_name <> ''
""")

cte("quoted_keys", "qi")(r"""
SELECT DISTINCT rfq_id, quote_seq, lower(regexp_replace(item_name, '^\s+|\s+$', '', 'g')) AS item_key
FROM qi WHERE item_name IS NOT NULL AND item_name <> ''
""")

cte("miss", "quotes", "req_keys", "quoted_keys")("""
SELECT q.rfq_id, q.quote_seq, count(*) AS n_missing,
       string_agg(r.item_key, ', ' ORDER BY r.item_key) AS missing_items
FROM quotes q JOIN req_keys r ON q.rfq_id = r.rfq_id
WHERE NOT EXISTS (SELECT 1 FROM quoted_keys k WHERE k.rfq_id = q.rfq_id
                  AND k.quote_seq = q.quote_seq AND k.item_key = r.item_key)
GROUP BY q.rfq_id, q.quote_seq
""")

cte("flags", "qi")("""
SELECT rfq_id, quote_seq,
       count(*) FILTER (WHERE packaging IS NULL OR packaging = '') AS n_pack,
       string_agg(item_name, ', ' ORDER BY item_pos, item_name)
           FILTER (WHERE (packaging IS NULL OR packaging = '') AND item_name <> '') AS l_pack,
       count(*) FILTER (WHERE portion IS NULL OR portion = '') AS n_port,
       string_agg(item_name, ', ' ORDER BY item_pos, item_name)
           FILTER (WHERE (portion IS NULL OR portion = '') AND item_name <> '') AS l_port
FROM qi GROUP BY rfq_id, quote_seq
""")

cte("gaps", "quotes", "miss", "flags", "rfq")("""
SELECT q.rfq_id, q.quote_seq,
       CASE WHEN q.supplier_name IS NULL OR q.supplier_name = '' THEN 'Unknown Supplier'
            ELSE q.supplier_name END AS supplier_name,
       coalesce(m.missing_items, 'None') AS missing_items,
       coalesce(nullif(concat_ws(', ',
           CASE WHEN q.delivery_terms IS NULL OR q.delivery_terms = '' THEN 'Delivery terms' END,
           CASE WHEN q.payment_terms IS NULL OR q.payment_terms = '' THEN 'Payment terms' END,
           CASE WHEN q.warranty IS NULL OR q.warranty = '' THEN 'Warranty' END,
           CASE WHEN coalesce(q.delivery_lead_time_days, 0) = 0 THEN 'Delivery lead time' END), ''),
           'None') AS missing_fields,
       coalesce(f.l_pack, 'None') AS items_missing_packaging,
       coalesce(f.l_port, 'None') AS items_missing_portion,
       coalesce(nullif(r.deadline_date, ''), 'Not specified') AS rfq_deadline,
       round(CAST(3 * coalesce(m.n_missing, 0)
             + (CASE WHEN q.delivery_terms IS NULL OR q.delivery_terms = '' THEN 1 ELSE 0 END)
             + (CASE WHEN q.payment_terms IS NULL OR q.payment_terms = '' THEN 1 ELSE 0 END)
             + (CASE WHEN q.warranty IS NULL OR q.warranty = '' THEN 1 ELSE 0 END)
             + (CASE WHEN coalesce(q.delivery_lead_time_days, 0) = 0 THEN 1 ELSE 0 END)
             + 0.5 * coalesce(f.n_pack, 0) + 0.5 * coalesce(f.n_port, 0) AS DOUBLE), 1) AS gap_score
FROM quotes q
LEFT JOIN miss m ON m.rfq_id = q.rfq_id AND m.quote_seq = q.quote_seq
LEFT JOIN flags f ON f.rfq_id = q.rfq_id AND f.quote_seq = q.quote_seq
LEFT JOIN rfq r ON r.rfq_id = q.rfq_id
""")

cte("outlay", "cost_rank", "quotes")(r"""
SELECT rfq_id, supplier_name, total_quoted_cost,
       coalesce(nullif(payment_terms, ''), 'Not specified') AS payment_terms,
       pct AS advance_payment_pct,
       CASE WHEN total_quoted_cost IS NOT NULL AND pct IS NOT NULL THEN CAST(up AS DOUBLE) END
           AS upfront_cash_required,
       CASE WHEN total_quoted_cost IS NOT NULL AND pct IS NOT NULL
            THEN CAST(CAST(total_quoted_cost AS DECIMAL(20,2)) - up AS DOUBLE) END
           AS balance_on_delivery,
       delivery_lead_time_days
FROM (
  SELECT *, round(CAST(total_quoted_cost AS DECIMAL(20,2)) * CAST(pct AS DECIMAL(6,2))
                  * CAST(0.01 AS DECIMAL(3,2)), 2) AS up
  FROM (
    SELECT c.rfq_id, c.supplier_name, c.total_quoted_cost, t.payment_terms,
           t.delivery_lead_time_days,
           CASE WHEN regexp_extract(t.payment_terms,
                 '(?i)(\d{1,3})\s*%\s*(?:advance|upfront|in advance)', 1) <> ''
                THEN least(CAST(regexp_extract(t.payment_terms,
                 '(?i)(\d{1,3})\s*%\s*(?:advance|upfront|in advance)', 1) AS DOUBLE), 100.0)
           END AS pct
    FROM cost_rank c LEFT JOIN (
      SELECT rfq_id, supplier_name, lt.p AS payment_terms, lt.l AS delivery_lead_time_days
      FROM (SELECT rfq_id, supplier_name,
                   arg_max({'p': payment_terms, 'l': delivery_lead_time_days}, quote_seq) AS lt
            FROM quotes GROUP BY rfq_id, supplier_name)) t
    ON c.rfq_id = t.rfq_id AND c.supplier_name = t.supplier_name))
""")

cte("recommend", "cost_rank", "gaps")("""
SELECT rfq_id, supplier_name, total_quoted_cost, savings_vs_cheapest, rank, gap_score,
       round(0.6 * (CASE WHEN cmax IS NULL THEN 0.0
                         ELSE (total_quoted_cost - cmin)
                              / (CASE WHEN cmax - cmin = 0 THEN 1.0 ELSE cmax - cmin END) END)
             + 0.4 * ((gap_score - gmin)
                      / (CASE WHEN gmax - gmin = 0 THEN 1.0 ELSE gmax - gmin END)), 6)
           AS composite_score
FROM (
  SELECT *, min(total_quoted_cost) OVER w AS cmin, max(total_quoted_cost) OVER w AS cmax,
         min(gap_score) OVER w AS gmin, max(gap_score) OVER w AS gmax
  FROM (
    SELECT c.*, coalesce(g.gap_score, max(g.gap_score) OVER (PARTITION BY c.rfq_id)) AS gap_score
    FROM cost_rank c LEFT JOIN gaps g
      ON c.rfq_id = g.rfq_id AND c.supplier_name = g.supplier_name)
  WINDOW w AS (PARTITION BY rfq_id))
""")

sql("missing_items", "quotes", "miss")("""
SELECT q.rfq_id, q.quote_seq, CAST(coalesce(m.n_missing, 0) AS INTEGER) AS n_missing,
       coalesce(m.missing_items, 'None') AS missing_items
FROM quotes q LEFT JOIN miss m ON m.rfq_id = q.rfq_id AND m.quote_seq = q.quote_seq
""")

sql("gap_analysis", "gaps")("SELECT * FROM gaps")

sql("cash_outlay", "outlay")("SELECT * FROM outlay")

sql("recommendation", "recommend")("SELECT * FROM recommend")

sql("best_supplier", "recommend")("""
SELECT rfq_id, supplier_name, composite_score, total_quoted_cost, gap_score
FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id
                 ORDER BY composite_score ASC NULLS LAST, supplier_name,
                          total_quoted_cost NULLS FIRST, gap_score NULLS FIRST) AS rn
      FROM recommend)
WHERE rn = 1
""")

cte("catalogue", "items")("""
SELECT rfq_id, supplier_name, CAST(n // 32 AS INTEGER) AS block, CAST(n % 32 AS INTEGER) AS position
FROM (SELECT rfq_id, supplier_name, row_number() OVER (PARTITION BY rfq_id ORDER BY supplier_name) - 1 AS n
      FROM (SELECT DISTINCT rfq_id, supplier_name FROM items WHERE unit_price IS NOT NULL AND item_name IS NOT NULL))
""")

_wide = lambda f, c, p: ", ".join(f"max({f}) FILTER ({c} = {i}) AS {p}{i}" for i in range(32))
sql("price_blocks", "items", "catalogue")(f"""
SELECT * FROM (
  SELECT m.rfq_id, c.block, m.item_name, {_wide('m.unit_price', 'c.position', 'p')}
  FROM (SELECT rfq_id, item_name, supplier_name, arg_min(unit_price, {{'q': quote_seq, 'p': item_pos}}) AS unit_price
        FROM items WHERE unit_price IS NOT NULL AND item_name IS NOT NULL GROUP BY ALL) m
  JOIN catalogue c ON c.rfq_id = m.rfq_id AND c.supplier_name = m.supplier_name
  GROUP BY m.rfq_id, c.block, m.item_name)
JOIN (SELECT rfq_id, block, {_wide('supplier_name', 'position', 's')} FROM catalogue GROUP BY rfq_id, block) USING (rfq_id, block)
""")

sql("presentation_order", "cost_rank", "gaps", "recommend")("""
SELECT 'total' AS view, rfq_id, supplier_name, CAST(NULL AS BIGINT) AS quote_seq,
       row_number() OVER (PARTITION BY rfq_id ORDER BY total_quoted_cost ASC NULLS LAST, supplier_name) AS position FROM cost_rank
UNION ALL
SELECT 'gap', rfq_id, supplier_name, quote_seq,
       row_number() OVER (PARTITION BY rfq_id ORDER BY gap_score ASC NULLS LAST, supplier_name, quote_seq) FROM gaps
UNION ALL
SELECT 'composite', rfq_id, supplier_name, NULL,
       row_number() OVER (PARTITION BY rfq_id ORDER BY composite_score ASC NULLS LAST, supplier_name) FROM recommend
""")

cte("gap_entry", "quotes", "req_keys", "quoted_keys", "qi")("""
SELECT q.rfq_id, q.quote_seq, 'missing_items' AS kind, 0 AS place, r.item_key AS entry
FROM quotes q JOIN req_keys r ON q.rfq_id = r.rfq_id
WHERE NOT EXISTS (SELECT 1 FROM quoted_keys k WHERE k.rfq_id = q.rfq_id AND k.quote_seq = q.quote_seq AND k.item_key = r.item_key)
UNION ALL
SELECT rfq_id, quote_seq, 'items_missing_packaging', item_pos, item_name FROM qi WHERE (packaging IS NULL OR packaging = '') AND item_name <> ''
UNION ALL
SELECT rfq_id, quote_seq, 'items_missing_portion', item_pos, item_name FROM qi WHERE (portion IS NULL OR portion = '') AND item_name <> ''
""")

sql("gap_list_segments", "gap_entry")("""
SELECT rfq_id, quote_seq, kind, CAST(n // 50 AS INTEGER) AS segment, CAST(count(*) AS INTEGER) AS n_entries, string_agg(entry, ', ' ORDER BY n) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id, quote_seq, kind ORDER BY place, entry) - 1 AS n FROM gap_entry)
GROUP BY rfq_id, quote_seq, kind, n // 50
""")
