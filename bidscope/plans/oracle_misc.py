"""SQL oracle statements for drafts, labels, prompts, records, index input,
file classification, page assembly and JSON coercion (DuckDB dialect)."""
from __future__ import annotations

from ..operators.drafts import TEXTS, UI_KEYS, UI_LABELS
from ..operators.extract import NON_JSON_NOTE
from .misc_queries import SUFFIXES
from .oracle_extract import lit, v
from .oracle_sql import cte, sql


def t(key: str, *args: str) -> str:
    """CASE over lang for a text with ``{}`` slots filled by SQL expressions."""
    def fill(tpl):
        parts = tpl.split("{}")
        out = [lit(parts[0])]
        for a, p in zip(args, parts[1:]):
            out += [a, lit(p)]
        return " || ".join(out)
    return f"(CASE WHEN lang = 'hi' THEN {fill(TEXTS['hi'][key])} ELSE {fill(TEXTS['en'][key])} END)"


def subject(key: str) -> str:
    return f"'RFQ ' || coalesce(rfq_ref, '') || ' - ' || {t(key)}"


NL = "chr(10)"

sql("gap_email", "gaps", "rfq")(f"""
SELECT rfq_id, quote_seq, lang, {subject('gap_subject')} AS subject,
       concat_ws('',
         {t('greeting', 'supplier_name')}, {NL} || {NL}, {t('gap_intro')}, {NL},
         CASE WHEN missing_items <> 'None' THEN {t('missing_items')} || missing_items || {NL} END,
         CASE WHEN missing_fields <> 'None' THEN {t('missing_fields')} || missing_fields || {NL} END,
         CASE WHEN deadline_date IS NOT NULL AND deadline_date <> ''
              THEN {NL} || {t('deadline', 'deadline_date')} || {NL} END,
         {NL}, {t('signoff')}) AS body,
       'draft_only' AS status
FROM (SELECT g.*, r.rfq_ref, r.deadline_date, l.lang
      FROM gaps g LEFT JOIN rfq r ON g.rfq_id = r.rfq_id
      CROSS JOIN (VALUES ('en'), ('hi')) l(lang))
""")

sql("award_email", "recommend", "rfq")(f"""
SELECT rfq_id, lang, supplier_name, {subject('award_subject')} AS subject,
       {t('greeting', 'supplier_name')} || {NL} || {NL} || {t('award_body', "coalesce(rfq_ref, '')")}
         || {NL} || {NL} || {t('signoff')} AS body,
       'draft_only' AS status
FROM (SELECT b.*, r.rfq_ref, l.lang FROM (
        SELECT rfq_id, supplier_name FROM (
          SELECT *, row_number() OVER (PARTITION BY rfq_id
                     ORDER BY composite_score ASC NULLS LAST, supplier_name,
                              total_quoted_cost NULLS FIRST, gap_score NULLS FIRST) AS rn
          FROM recommend) WHERE rn = 1) b
      LEFT JOIN rfq r ON b.rfq_id = r.rfq_id CROSS JOIN (VALUES ('en'), ('hi')) l(lang))
""")

_keys = UI_KEYS + ["chart_title"]
_labels = ", ".join(f"({lit(lg)}, {lit(k)}, {lit(x)})" for lg, m in UI_LABELS.items() for k, x in m.items())
sql("localize")(f"""
SELECT d.doc_id, d.lang, d.key, coalesce(l.text, d.key) AS text
FROM (SELECT doc_id, lang, [{', '.join(lit(k) for k in _keys)}][doc_id % {len(_keys)} + 1] AS key
      FROM documents) d
LEFT JOIN (VALUES {_labels}) l(lang, key, text)
  ON l.key = d.key AND l.lang = CASE WHEN d.lang IN ('en', 'hi') THEN d.lang ELSE 'en' END
""")

sql("prompts")("""
SELECT doc_id, length(text) AS n_chars, CAST(p AS INTEGER) AS part_no, substr(text, p * 12000 + 1, 12000) AS user_content
FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 12000.0) AS BIGINT)))) AS p FROM documents WHERE text IS NOT NULL)
""")

sql("records_roundtrip", "rfq", "kv_docs")(f"""
SELECT 'quotation' AS record_type, doc_id, NULL AS rfq_key, raw_text, 36 AS id_chars, true AS has_time FROM kv_docs
UNION ALL
SELECT 'rfq', NULL, rfq_id, concat_ws({NL}, 'RFQ Ref: ' || rfq_ref, 'Deadline: ' || deadline_date), 36, true FROM rfq
""")

sql("records_upsert", "rfq", "kv_docs")(f"""
SELECT 'quotation-' || {v('doc_id')} AS id, 'quotation' AS record_type,
       CASE WHEN doc_id % 3 = 0 THEN 'revised: ' ELSE '' END || raw_text AS raw_text,
       CASE WHEN doc_id % 3 = 0 THEN '2026-01-03' ELSE '2026-01-02' END AS day
FROM kv_docs
UNION ALL
SELECT 'rfq-' || rfq_id, 'rfq',
       CASE WHEN right(rfq_id, 1) IN ('1', '3') THEN 'revised: ' ELSE '' END
       || concat_ws({NL}, 'RFQ Ref: ' || rfq_ref, 'Deadline: ' || deadline_date),
       CASE WHEN right(rfq_id, 1) IN ('1', '3') THEN '2026-01-06' ELSE '2026-01-02' END
FROM rfq
""")

sql("records_by_type", "kv_head")("""
SELECT h.doc_id, 'quotation' AS record_type, supplier_name, quotation_ref, rfq_ref, deadline_date,
       delivery_terms, delivery_lead_time_days, payment_terms, warranty,
       CAST(length(k.raw_text) AS INTEGER) AS stored_chars
FROM kv_docs k JOIN kv_head h ON h.doc_id = k.doc_id
""")

sql("union_docs", "rfq", "kv_docs", "kv_head")(f"""
SELECT rfq_id || '.xlsx' AS source, 'excel' AS file_type, 'RFQ (Buyer requirements)' AS supplier_name,
       concat_ws({NL}, 'RFQ Ref: ' || rfq_ref, 'Deadline: ' || deadline_date) AS raw_text
FROM rfq
UNION ALL
SELECT 'Q_' || {v('k.doc_id')} || '.' || k.file_type AS source, k.file_type,
       CASE WHEN h.supplier_name IS NULL OR h.supplier_name = '' THEN 'Q_' || {v('k.doc_id')}
            ELSE h.supplier_name END AS supplier_name,
       k.raw_text
FROM kv_docs k LEFT JOIN kv_head h ON h.doc_id = k.doc_id
""")

sql("classify_files")(rf"""
SELECT doc_id, path, ft AS file_type, ft IS NOT NULL AS supported,
       regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '^(.+?)(\.[^.]*)?$', 1) AS supplier_default
FROM (SELECT doc_id, path,
             CASE lower(regexp_extract(path, '(\.[^./\\]+)$', 1))
                  WHEN '.xlsx' THEN 'excel' WHEN '.xls' THEN 'excel' WHEN '.xlsm' THEN 'excel'
                  WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.doc' THEN 'docx' END AS ft
      FROM (SELECT doc_id, source || '/doc_' || {v('doc_id')}
                   || [{', '.join(lit(s) for s in SUFFIXES)}][doc_id % {len(SUFFIXES)} + 1] AS path
            FROM documents))
""")

sql("assemble_pages")(f"""
SELECT doc_id, 'pdf' AS file_type,
       'PDF file: doc_' || {v('doc_id')} || '.pdf' || {NL}
       || string_agg({NL} || '--- Page ' || {v('page_no')} || ' ---' || {NL} || page, {NL}
                     ORDER BY page_no) AS raw_text
FROM (SELECT doc_id, generate_subscripts(p, 1) AS page_no, unnest(p) AS page
      FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM documents))
GROUP BY doc_id
""")

_name = "'\"' || p_name || '\"'"
cte("json_src")(f"""
SELECT p_partkey AS doc_id, CASE p_partkey % 5
  WHEN 0 THEN '{{"supplier_name": ' || {_name} || ', "items": ['
  WHEN 1 THEN '{{"supplier_name": ' || {_name} || ', "quotation_ref": "Q-' || {v('p_partkey')}
              || '", "items": [{{"item_name": "' || p_type || '", "quantity": ' || {v('p_size')}
              || ', "unit_price": "' || {v('CAST(floor(p_retailprice) AS BIGINT)')} || '.5"}}], "extra": true}}'
  WHEN 2 THEN '{{"supplier_name": null, "items": "none", "delivery_lead_time_days": ' || {v('p_size')} || '}}'
  WHEN 3 THEN 'not json at all'
  WHEN 4 THEN '{{"currency": "INR", "items": [], "warranty": "' || {v('p_size')} || ' months"}}'
END AS text FROM part
""")

sql("coerce_json", "json_src")(f"""
SELECT doc_id, ok AS is_valid,
       CASE WHEN ok THEN json_extract_string(j, '$.supplier_name') END AS supplier_name,
       CASE WHEN ok THEN json_extract_string(j, '$.quotation_ref') END AS quotation_ref,
       CASE WHEN ok THEN json_extract_string(j, '$.currency') END AS currency,
       CASE WHEN ok THEN json_extract_string(j, '$.warranty') END AS warranty,
       CASE WHEN ok THEN json_extract_string(j, '$.delivery_lead_time_days') END
           AS delivery_lead_time_days,
       CAST(CASE WHEN ok AND json_type(j, '$.items') = 'ARRAY'
                 THEN json_array_length(j, '$.items') ELSE 0 END AS INTEGER) AS n_items,
       CASE WHEN ok THEN json_extract_string(j, '$.items[0].item_name') END AS first_item_name,
       CASE WHEN ok THEN json_extract_string(j, '$.items[0].quantity') END AS first_item_quantity,
       CASE WHEN ok THEN json_extract_string(j, '$.notes') ELSE {lit(NON_JSON_NOTE)} END AS notes,
       CASE WHEN NOT ok THEN text END AS raw_output
FROM (SELECT *, CASE WHEN ok THEN text END AS j FROM (
        SELECT doc_id, text,
               coalesce(json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT',
                        false) AS ok
        FROM json_src))
""")
