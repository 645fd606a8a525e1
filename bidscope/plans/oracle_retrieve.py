"""SQL oracle statements for the retrieval queries (DuckDB dialect)."""
from __future__ import annotations

from .oracle_extract import strip
from .oracle_sql import cte, sql

sql("chunk_fixed")(f"""
SELECT doc_id, source, 'unknown' AS file_type, CAST(NULL AS VARCHAR) AS supplier_name,
       CAST(generate_subscripts(st, 1) - 1 AS INTEGER) AS chunk_index,
       unnest(st) AS start,
       substr(text, unnest(st), 800) AS text
FROM (SELECT doc_id, coalesce(source, 'unknown') AS source, text,
             generate_series(1, greatest(length(text), 1), 680) AS st
      FROM documents WHERE {strip('text')} <> '')
""")

cte("centroids")("""
SELECT query_id, list(x ORDER BY pos) AS embedding FROM (
  SELECT label AS query_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
    SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings)
  GROUP BY label, pos)
GROUP BY query_id
""")

cte("topk", "centroids")("""
SELECT query_id, hit_id, CAST(rk AS INTEGER) AS rank, round(score, 9) AS score FROM (
  SELECT query_id, hit_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score, hit_id) AS rk
  FROM (SELECT c.query_id, e.vec_id AS hit_id,
               list_reduce(list_transform(list_zip(c.embedding, CAST(e.embedding AS DOUBLE[])),
                                          lambda t: (t[1] - t[2]) * (t[1] - t[2])),
                           lambda a, b: a + b) AS score
        FROM centroids c, embeddings e))
WHERE rk <= 6
""")

sql("similarity_topk", "topk")("SELECT * FROM topk")

cte("chunks")(f"""
SELECT doc_id, source, chunk_index, substr(text, st, 800) AS text FROM (
  SELECT doc_id, source, text, generate_subscripts(st, 1) - 1 AS chunk_index, unnest(st) AS st FROM (
    SELECT doc_id, coalesce(source, 'unknown') AS source, text,
           generate_series(1, greatest(length(text), 1), 680) AS st
    FROM documents WHERE {strip('text')} <> ''))
""")


def _profile(t: str) -> str:
    return (f"list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda x: "
            f"floor((length(lower({t})) - length(replace(lower({t}), x, ''))) * 1000.0::DOUBLE / greatest(length(lower({t})), 1)))")


sql("ask_answer", "chunks")(f"""
SELECT q.query_id,
       CASE WHEN a.body IS NULL THEN 'No relevant information found in the indexed documents.'
            ELSE 'No model function given — showing the most relevant raw excerpts instead:'
                 || chr(10) || chr(10) || a.body END AS answer,
       CAST(coalesce(a.n, 0) AS INTEGER) AS n_sources, coalesce(a.labels, '') AS source_labels,
       coalesce(a.texts, '') AS source_texts
FROM (SELECT DISTINCT CAST(item_id AS BIGINT) AS query_id FROM benchmark) q
LEFT JOIN (
  SELECT query_id, count(*) AS n,
         string_agg('**' || label || '**' || chr(10) || '> ' || preview || chr(10), chr(10) ORDER BY rk) AS body,
         string_agg(label, chr(30) ORDER BY rk) AS labels, string_agg(text, chr(30) ORDER BY rk) AS texts
  FROM (
    SELECT query_id, coalesce(nullif(source, ''), 'Unknown source') AS label, text, {strip('substr(text, 1, 400)')} AS preview,
           row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id, chunk_index) AS rk
    FROM (SELECT b.query_id, c.doc_id, c.chunk_index, c.source, c.text,
                 list_reduce(list_transform(list_zip(b.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])),
                             lambda x, y: x + y) AS score
          FROM (SELECT item_id AS query_id, {_profile('text')} AS v FROM benchmark) b,
               (SELECT *, {_profile('text')} AS v FROM chunks) c))
  WHERE rk <= 6 GROUP BY query_id) a ON a.query_id = q.query_id
""")

sql("chunk_recursive")(f"""
SELECT doc_id, true AS chunks_ok, 0 AS uncovered FROM documents WHERE {strip('text')} <> ''
""")

sql("index_append")(f"""
SELECT doc_id, coalesce(source, 'unknown') AS source, 26 AS dims, true AS ids_differ, true AS chunks_ok, 0 AS uncovered
FROM (SELECT doc_id, source, text FROM documents UNION ALL SELECT -item_id - 1, 'benchmark', text FROM benchmark)
WHERE {strip('text')} <> ''
""")

sql("embed_topk")("""
SELECT item_id, 6 AS n_hits, '1,2,3,4,5,6' AS ranks, true AS ascending FROM benchmark
""")

_EVERY = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark) WHERE {strip('text')} <> ''"

sql("index_versions")(f"""
SELECT doc_id, true AS chunks_ok, 0 AS uncovered, true AS chunks_once, true AS old_kept FROM {_EVERY}
""")

sql("index_statistics")(f"SELECT doc_id, true AS same FROM {_EVERY}")

sql("approx_topk")("SELECT item_id, 6 AS n_hits, 6 AS last_rank, true AS recall_reached FROM benchmark")
