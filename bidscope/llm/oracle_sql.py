"""DuckDB statements for the queries that SQL can express."""
from __future__ import annotations

# unsigned crc32 of a text's UTF-8 bytes, half a byte at a time; fixed values: the table of the reflected polynomial 0xEDB88320
_CRC_TABLE = ("[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
              "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]")


def _crc32(text: str) -> str:
    digits = f"list_filter(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda d: d <> '')"
    steps = (f"list_reduce(list_prepend(4294967295::BIGINT, list_transform({digits}, lambda d: strpos('0123456789ABCDEF', d)::BIGINT - 1)), "
             f"lambda c, d: xor(({_CRC_TABLE}::BIGINT[])[xor(c, d) % 16 + 1], c >> 4))")
    return f"xor({steps}, 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 AND doc_id IS NOT NULL THEN {_leaf(_LOW)} END AS altered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS size FROM leaves),
tree AS (
  SELECT 0 AS lvl, k, pos, leaf AS h, size FROM placed
  UNION ALL
  SELECT lvl + 1, k, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM tree WHERE size > 1 GROUP BY lvl, k, pos // 8),
subs AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS size, lvl AS depth FROM tree WHERE size = 1),
upper AS (
  SELECT 0 AS lvl, pos, subroot AS h, size FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM upper WHERE size > 1 GROUP BY lvl, pos // 8),
top AS (SELECT h AS root, lvl AS height FROM upper WHERE size = 1),
lower_steps AS (
  SELECT p.k, p.pos, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos // (1 << 3 * t.lvl)), '') AS l,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos // (1 << 3 * t.lvl)), '') AS r
  FROM placed p JOIN tree t ON t.k = p.k AND t.size > 1 AND t.pos // 8 = p.pos // (8 * (1 << 3 * t.lvl))
  GROUP BY p.k, p.pos, t.lvl),
upper_steps AS (
  SELECT s.k, u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos // (1 << 3 * u.lvl)), '') AS l,
         coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos // (1 << 3 * u.lvl)), '') AS r
  FROM subs s JOIN upper u ON u.size > 1 AND u.pos // 8 = s.pos // (8 * (1 << 3 * u.lvl))
  GROUP BY s.k, u.lvl),
steps AS (
  SELECT k, pos, lvl, l, r FROM lower_steps
  UNION ALL
  SELECT p.k, p.pos, s.depth + u.lvl, u.l, u.r FROM placed p JOIN subs s USING (k) JOIN upper_steps u USING (k)),
fold AS (
  SELECT k, pos, 0 AS lvl, coalesce(altered, leaf) AS h FROM placed
  UNION ALL
  SELECT f.k, f.pos, f.lvl + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s USING (k, pos, lvl)),
proofs AS (SELECT k, pos, string_agg(l || r, '' ORDER BY lvl) AS proof FROM steps GROUP BY k, pos)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM placed p JOIN subs s USING (k) CROSS JOIN top t LEFT JOIN proofs q ON q.k = p.k AND q.pos = p.pos
JOIN fold f ON f.k = p.k AND f.pos = p.pos AND f.lvl = s.depth + t.height
"""

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w
  FROM documents),
counted AS (SELECT d, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY d, w),
hashed AS (SELECT w, n, {_crc32("d || ':' || w")} AS h FROM counted),
lost AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocab v ON v.word = c.rest
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocab v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= 5 * v.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * v.n THEN b.other_n END AS form_n
  FROM vocab v LEFT JOIN best b USING (word)),
path AS (
  SELECT word, word AS here, 0 AS lvl FROM forms
  UNION ALL
  SELECT p.word, f.form, p.lvl + 1 FROM path p JOIN forms f ON f.word = p.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, lvl) AS root FROM path GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends l USING (word)
"""

SQL = {"op11_merkle_manifest": MERKLE, "op13_spelling_variants": SPELLING}
