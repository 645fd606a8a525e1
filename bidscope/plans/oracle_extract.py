"""SQL oracle statements for the extraction queries (DuckDB dialect)."""
from __future__ import annotations

from ..functions.aliases import HEADER_FIELD_ALIASES, ITEM_COLUMN_ALIASES, sql_match
from ..sources.derived_text import HEADER_VARIANTS, TABLE_HEADERS
from .oracle_sql import cte, sql

DEV = "०१२३४५६७८९"
LB = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
ITEM_LINE_RE2 = (r"(?i)^([A-Za-z][A-Za-z0-9 /\-\.\(\)]{2,50}?)\s+"
                 r"Qty\s*([\d,]+(?:\.\d+)?)\s*([A-Za-z]+)?\s+"
                 r"Unit Price\s*(?:Rs\.?|₹|\$)?\s*([\d,]+(?:\.\d+)?)"
                 r"(?:\s+Portion:\s*([^:]+?))?"
                 r"(?:\s+Packaging:\s*(.+))?$")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


WS = r"[\s\x{0B}\x{85}\x{A0}\x{1C}-\x{1F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def nk(x: str) -> str:
    return f"lower(regexp_replace({strip(x)}, '{WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    inner = (rf"regexp_extract(regexp_replace(translate({x}, '{DEV}', '0123456789'), "
             rf"'(?i)[₹$]|rs\.?|inr|usd', '', 'g'), '-?\d[\d,]*\.?\d*', 0)")
    return f"TRY_CAST(nullif(replace({inner}, ',', ''), '') AS DOUBLE)"


def ndate(x: str, iso_first: bool = False) -> str:
    s = f"translate({x}, '{DEV}', '0123456789')"
    dmy = r"'(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})'"
    d, m, y = (f"regexp_extract({s}, {dmy}, {i})" for i in (1, 2, 3))
    dmy_v = f"(CASE WHEN length({y}) = 4 THEN {y} ELSE '20' || {y} END) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    iso_c = rf"regexp_matches({s}, '^\d{{4}}-\d{{2}}-\d{{2}}')"
    iso_v = f"substr({s}, 1, 10)"
    dmy_c = f"regexp_matches({s}, {dmy})"
    body = (f"WHEN {iso_c} THEN {iso_v} WHEN {dmy_c} THEN {dmy_v}" if iso_first
            else f"WHEN {dmy_c} THEN {dmy_v} WHEN {iso_c} THEN {iso_v}")
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL {body} END)"


def adv(x: str) -> str:
    g = (rf"regexp_extract(translate({x}, '{DEV}', '0123456789'), "
         rf"'(?i)(\d{{1,3}})\s*%\s*(?:advance|upfront|in advance)', 1)")
    return f"(CASE WHEN {g} <> '' THEN least(CAST({g} AS DOUBLE), 100.0) END)"


def pick(k: str, n: int, *cases: str) -> str:
    return f"(CASE {k} % {n} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END)"


# ---- derived inputs ------------------------------------------------------

cte("hdr_texts")(f"""
SELECT p_partkey, [{', '.join(lit(h) for h in HEADER_VARIANTS)}][p_partkey % {len(HEADER_VARIANTS)} + 1]
       || CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_type ELSE '' END AS header
FROM part
""")

_z = v("p_size")
cte("num_texts")(f"""
SELECT p_partkey, {pick('p_partkey', 10,
    f"'Rs. ' || {v('p_partkey % 97')} || ',' || lpad({_z}, 3, '0') || '.50'",
    f"{_z} || '-' || {v('p_size + 2')} || ' days'",
    f"'₹' || {v('p_partkey')}",
    f"'.' || {_z}",
    "'n/a'",
    f"'USD ' || {v('p_partkey')} || '.'",
    f"'1,00,' || lpad({_z}, 3, '0') || '.25'",
    f"'-' || {_z} || ' units'",
    f"translate({_z}, '0123456789', '{DEV}') || ' kg'",
    "NULL")} AS raw_value
FROM part
""")

_dd, _mm, _yy = v("p_partkey % 28 + 1"), v("p_partkey % 12 + 1"), v("p_partkey % 10 + 2020")
cte("date_texts")(f"""
SELECT p_partkey, {pick('p_partkey', 8,
    f"lpad({_dd}, 2, '0') || '/' || lpad({_mm}, 2, '0') || '/' || {_yy}",
    f"{_dd} || '-' || {_mm} || '-' || {v('p_partkey % 10 + 20')}",
    f"{_yy} || '-' || lpad({_mm}, 2, '0') || '-' || lpad({_dd}, 2, '0')",
    "'soon'",
    f"{_dd} || '/13/' || {_yy}",
    f"'by ' || {_dd} || '.' || {_mm} || '.' || {_yy}",
    "NULL",
    "''")} AS raw_value
FROM part
""")

cte("terms_texts")(f"""
SELECT p_partkey, {pick('p_partkey', 8,
    f"{v('p_partkey % 100')} || '% advance, balance on delivery'",
    f"{v('p_partkey % 300')} || ' % UPFRONT'",
    f"'Advance ' || {v('p_partkey % 50')} || '%'",
    f"{v('p_partkey % 20')} || '.5% advance'",
    f"translate({v('p_partkey % 100')}, '0123456789', '{DEV}') || '% advance'",
    f"'Net ' || {v('p_partkey % 60')}",
    "NULL",
    f"{v('p_partkey % 100')} || '%in advance'")} AS payment_terms
FROM part
""")

_n = v("s_nationkey")
cte("kv_docs")(f"""
SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'docx' ELSE 'pdf' END AS file_type,
       concat_ws(chr(10),
         'Supplier Quotation',
         'Supplier: ' || s_name,
         'Quotation Ref: Q-' || {v('s_suppkey')},
         'RFQ No : RFQ-' || {_n} || chr(13),
         'Deadline: ' || lpad({v('s_suppkey % 28 + 1')}, 2, '0') || '/'
                      || lpad({v('s_suppkey % 12 + 1')}, 2, '0') || '/2026',
         'Closing Date: soon',
         'Lead Time (days): ' || {_n} || ' days',
         'Delivery Time: tbd',
         'Payment Terms: ' || {v('s_suppkey % 5 * 10')} || '% advance',
         'Warranty:' || CASE WHEN s_suppkey % 3 = 0 THEN '   ' ELSE ' 12 months' END,
         'Currency: ' || CASE WHEN s_suppkey % 4 = 0 THEN 'INR Qty 5' ELSE 'USD' END,
         'Note: no colon issues: here',
         'Delivery Terms: FOB port ' || {_n}) AS raw_text
FROM supplier
""")

_k = "p_partkey"
_price = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)"
cte("lines_src")(f"""
SELECT CAST(p_partkey // 1000 AS VARCHAR) || '/' || p_brand AS doc_id, p_partkey AS line_no,
       CASE WHEN {_k} % 11 = 0 THEN 'Total for ' || p_name ELSE
         p_name || '  Qty ' || {_z} || CASE WHEN {_k} % 5 = 0 THEN '' ELSE ' pcs' END || '  '
         || ['Unit Price Rs. ', 'unit price $', 'Unit Price '][{_k} % 3 + 1]
         || {_price} || '.' || lpad({v(f'{_k} % 100')}, 2, '0')
         || CASE WHEN {_k} % 2 = 0 THEN '  Portion: ' || p_type ELSE '' END
         || CASE WHEN {_k} % 7 < 4 THEN '  Packaging: Box of ' || {_z} ELSE '' END
       END AS line
FROM part
""")


def _cells(vals):
    return "[" + ", ".join(f"{{'col_no': {i + 1}, 'value': {x}}}" for i, x in enumerate(vals)) + "]"


_t0 = [f"CASE WHEN {_k} % 13 = 0 THEN '' ELSE p_name END", _z, "'pcs'", f"'Rs. ' || {_price} || '.50'",
       f"CASE WHEN {_k} % 4 = 0 THEN NULL ELSE {v('CAST(floor(p_retailprice) AS BIGINT) * p_size')} END",
       f"CASE WHEN {_k} % 5 = 0 THEN 'nan' ELSE p_type END", f"'Box of ' || {_z}"]
_t1 = ["p_name", f"{_z} || ' nos'", f"'INR ' || {_price}", f"{_price} || '.75'", "'ok'",
       f"CASE WHEN {_k} % 2 = 0 THEN '  ' ELSE 'Carton' END", "'kg'",
       f"CASE WHEN {_k} % 3 = 0 THEN '' ELSE {v('p_size * 2')} END"]

cte("cells")(rf"""
SELECT doc_id, table_no, row_no, c.col_no AS col_no, CAST(c.value AS VARCHAR) AS value FROM (
  SELECT CAST(p_partkey // 1000 AS VARCHAR) || '/' || p_brand AS doc_id, CAST(p_size % 2 AS INTEGER) AS table_no, p_partkey + 1 AS row_no,
         unnest(CASE WHEN p_size % 2 = 0 THEN {_cells(_t0)} ELSE {_cells(_t1)} END) AS c
  FROM part)
UNION ALL
SELECT doc_id, table_no, CAST(0 AS BIGINT) AS row_no, CAST(generate_subscripts(h, 1) AS INTEGER) AS col_no,
       unnest(h) AS value FROM (
  SELECT DISTINCT CAST(p_partkey // 1000 AS VARCHAR) || '/' || p_brand AS doc_id, CAST(p_size % 2 AS INTEGER) AS table_no,
         CASE CAST(p_size % 2 AS INTEGER)
              + CASE WHEN CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) % 3 = 0 THEN 0 ELSE 2 END
              {' '.join(f"WHEN {i} THEN [{', '.join(lit(h) for h in hs)}]" for i, hs in TABLE_HEADERS.items())}
         END AS h
  FROM part)
""")

# ---- extraction --------------------------------------------------------------

_fields9 = list(HEADER_FIELD_ALIASES)
cte("kv_rows", "kv_docs")(f"""
SELECT doc_id, line_no, field, value,
       CASE field WHEN 'deadline_date' THEN {ndate(strip('value'), True)}
                  WHEN 'delivery_lead_time_days' THEN {v(f'CAST(trunc({clean("value")}) AS INTEGER)')}
                  ELSE {strip('value')} END AS pv
FROM (
  SELECT doc_id, file_type, line_no, {sql_match(nk("split_part(line, ':', 1)"), HEADER_FIELD_ALIASES)} AS field,
         substr(line, instr(line, ':') + 1) AS value
  FROM (SELECT doc_id, file_type, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, file_type, string_split_regex(raw_text, '{LB}') AS l FROM kv_docs))
  WHERE instr(line, ':') > 0)
WHERE field IS NOT NULL AND {strip('value')} <> '' AND (file_type <> 'pdf' OR NOT contains(value, 'Qty'))
""")

cte("kv_head", "kv_rows")(
    "SELECT doc_id, " + ", ".join(
        (f"CAST(arg_max(pv, line_no) FILTER (WHERE field = '{f}' AND pv IS NOT NULL) AS INTEGER) AS {f}"
         if f == "delivery_lead_time_days" else
         f"arg_max(pv, line_no) FILTER (WHERE field = '{f}' AND pv IS NOT NULL) AS {f}")
        for f in _fields9) + " FROM kv_rows GROUP BY doc_id")

_num = ("quantity", "unit_price", "total_price")
cte("tab_items", "cells")(f"""
SELECT * FROM (
  SELECT doc_id, table_no, row_no, {', '.join(
      f"arg_max({{'x': {'n' if f in _num else 't'}}}, key_pos) FILTER (WHERE field = '{f}').x AS {f}"
      for f in ITEM_COLUMN_ALIASES)}
  FROM (
    SELECT c.doc_id, c.table_no, c.row_no, k.field, k.key_pos,
           CASE WHEN k.field IN ('quantity', 'unit_price', 'total_price') THEN {clean('c.value')} END AS n,
           CASE WHEN k.field NOT IN ('quantity', 'unit_price', 'total_price') THEN {strip('c.value')} END AS t
    FROM cells c JOIN (
      SELECT * FROM (
        SELECT doc_id, table_no, key_pos, col_no, {sql_match(nk('header'), ITEM_COLUMN_ALIASES)} AS field
        FROM (SELECT doc_id, table_no, value AS header, min(col_no) AS key_pos, max(col_no) AS col_no
              FROM cells WHERE row_no = 0 GROUP BY doc_id, table_no, value)) m
      WHERE field IS NOT NULL AND EXISTS (
        SELECT 1 FROM cells h WHERE h.row_no = 0 AND h.doc_id = m.doc_id AND h.table_no = m.table_no
          AND {sql_match(nk('h.value'), ITEM_COLUMN_ALIASES)} = 'item_name')) k
      ON c.doc_id = k.doc_id AND c.table_no = k.table_no AND c.col_no = k.col_no
    WHERE c.row_no > 0 AND c.value IS NOT NULL AND {strip('c.value')} <> '' AND lower(c.value) <> 'nan')
  GROUP BY doc_id, table_no, row_no)
WHERE item_name IS NOT NULL AND item_name <> ''
""")

_s = strip("line")
_g = lambda i: f"regexp_extract({_s}, '{ITEM_LINE_RE2}', {i})"
cte("line_items_all", "lines_src")(f"""
SELECT doc_id, line_no, {strip(_g(1))} AS item_name, {clean(_g(2))} AS quantity,
       CASE WHEN {_g(3)} <> '' THEN {_g(3)} END AS unit, {clean(_g(4))} AS unit_price,
       CAST(NULL AS DOUBLE) AS total_price,
       CASE WHEN {_g(5)} <> '' THEN {strip(_g(5))} END AS portion,
       CASE WHEN {_g(6)} <> '' THEN {strip(_g(6))} END AS packaging
FROM lines_src WHERE regexp_matches({_s}, '{ITEM_LINE_RE2}')
""")

# ---- registered statements -----------------------------------------------

sql("normalize_keys", "hdr_texts")(f"SELECT p_partkey, header, {nk('header')} AS header_key FROM hdr_texts")

sql("alias_match", "hdr_texts")(f"""
SELECT p_partkey, {nk('header')} AS header_key,
       {sql_match(nk('header'), HEADER_FIELD_ALIASES)} AS header_field,
       {sql_match(nk('header'), ITEM_COLUMN_ALIASES)} AS item_field
FROM hdr_texts
""")

def _alias_of(order: str) -> str:
    """The first alias by ``order``, an exact one before all others."""
    return (f"(SELECT key, first(field ORDER BY alias <> key, CASE WHEN alias <> key THEN {order} END, field) AS field "
            "FROM type_keys JOIN type_aliases ON starts_with(key, alias) GROUP BY key)")


cte("type_aliases")("""
SELECT alias, field FROM (
  SELECT DISTINCT array_to_string(list_slice(w, 1, n), ' ') AS alias, n || '/' || array_to_string(list_slice(w, 1, n), ' ') AS field
  FROM (SELECT string_split(lower(trim(p_type)), ' ') AS w, unnest([1, 2, 9]) AS n FROM part))
""")

cte("type_texts")("""
SELECT p_partkey, text, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS key
FROM (SELECT p_partkey, p_type || CASE WHEN p_size % 4 = 0 THEN '' ELSE '  Size ' || p_size END AS text FROM part)
""")

cte("type_keys", "type_texts")("SELECT DISTINCT key FROM type_texts")

sql("alias_table", "type_aliases", "type_texts", "type_keys", "hdr_texts")(f"""
SELECT t.p_partkey, t.text, a.field AS family, b.field AS kind, {sql_match(nk('header'), HEADER_FIELD_ALIASES)} AS header_field
FROM type_texts t LEFT JOIN {_alias_of('field')} a ON a.key = t.key LEFT JOIN {_alias_of("lpad(CAST(1000 - length(alias) AS VARCHAR), 4, '0')")} b ON b.key = t.key
JOIN hdr_texts h ON h.p_partkey = t.p_partkey
""")

sql("clean_numbers", "num_texts")(f"SELECT p_partkey, raw_value, {clean('raw_value')} AS number FROM num_texts")

sql("normalize_dates", "date_texts")(f"""
SELECT p_partkey, raw_value, {ndate('raw_value')} AS deadline_date,
       CAST(try_strptime({ndate('raw_value')}, '%Y-%m-%d') AS DATE) AS deadline,
       {ndate('raw_value', True)} AS deadline_date_iso_first
FROM date_texts
""")

sql("advance_pct", "terms_texts")(f"""
SELECT p_partkey, payment_terms, {adv('payment_terms')} AS advance_payment_pct FROM terms_texts
""")

sql("kv_header_fields", "kv_head")("SELECT * FROM kv_head")

sql("items_from_cells", "tab_items")("SELECT * FROM tab_items")

sql("line_items_from_text", "line_items_all", "tab_items")("""
SELECT * FROM line_items_all l
WHERE NOT EXISTS (SELECT 1 FROM tab_items t WHERE t.doc_id = l.doc_id)
""")

sql("infer_currency")(r"""
SELECT doc_id,
       CASE WHEN contains(text, '₹') OR regexp_matches(text, '(?i)\bINR\b|\bRs\.?\b') THEN 'INR'
            WHEN contains(text, '$') OR regexp_matches(text, '(?i)\bUSD\b') THEN 'USD' END AS currency
FROM documents
""")

_brand_n = r"CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER)"
_two = "lpad(CAST({} AS VARCHAR), 2, '0')".format
sql("extract_documents", "tab_items", "line_items_all")(f"""
SELECT d.doc_id, file_type, 'Maker ' || {v('n')} AS supplier_name,
       CASE WHEN file_type = 'pdf' THEN '2026-' || {_two('n % 12 + 1')} || '-' || {_two('n % 9 + 1')}
            ELSE '2027-' || {_two('n % 12 + 1')} || '-' || {_two('n % 28 + 1')} END AS deadline_date,
       CASE WHEN file_type = 'excel' AND n % 4 = 0 THEN '2 years' END AS warranty,
       CAST(coalesce(t.c, l.c, 0) AS INTEGER) AS n_items, round(coalesce(t.q, l.q, 0), 2) AS quantity, coalesce(t.f, l.f) AS first_name
FROM (SELECT CAST(p_partkey // 1000 AS VARCHAR) || '/' || p_brand AS doc_id, min({_brand_n}) AS n, CASE WHEN min({_brand_n}) % 2 = 0 THEN 'excel' ELSE 'pdf' END AS file_type FROM part GROUP BY CAST(p_partkey // 1000 AS VARCHAR) || '/' || p_brand) d
LEFT JOIN (SELECT doc_id, count(*) AS c, sum(coalesce(quantity, 0)) AS q, min(item_name) AS f FROM tab_items GROUP BY doc_id) t ON t.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS c, sum(coalesce(quantity, 0)) AS q, min(item_name) AS f FROM line_items_all GROUP BY doc_id) l
       ON l.doc_id = d.doc_id AND d.file_type = 'pdf' AND t.doc_id IS NULL
""")

sql("link_records")("""
SELECT doc_id, rfq_id, CASE WHEN rfq_id IS NOT NULL THEN row_number() OVER (PARTITION BY rfq_id ORDER BY doc_id) - 1 END AS quote_seq,
       CASE WHEN rfq_id IS NOT NULL THEN '70% advance' END AS last_terms
FROM (SELECT s_suppkey + v * 1099511627776 AS doc_id, CASE WHEN s_nationkey % 3 <> 2 THEN s_nationkey END AS rfq_id
      FROM supplier, (VALUES (0), (1)) t(v))
""")
