"""DuckDB SQL of the queries that SQL can express. The others hang on Spark's hash, trained models or tokenizers; tests hold those against plain Python."""

from .chat_format import BODY, CODES, CONTROL, END, ESCAPE, TURN
from .line_dedup import MIN_DOCS
from .ngram_join import PERCENT, WORDS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def lower(sql: str) -> str:
    return f"translate({sql}, '{UPPER}', '{UPPER.lower()}')"


def escaped(sql: str) -> str:
    sql = f"replace({sql}, '{ESCAPE}', '{ESCAPE}e')"
    for control, code in zip(CONTROL, CODES):
        sql = f"replace({sql}, '{control}', '{ESCAPE}{code}')"
    return sql


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= {WORDS} THEN list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (na + nb - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(s, t) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.s, g.b FROM r JOIN g ON g.a = r.t)
SELECT r.s AS doc_id, CAST(any_value(len(ss)) AS BIGINT) AS n_shingles, min(r.t) AS component_id FROM r JOIN s ON s.doc_id = r.s GROUP BY r.s
"""

OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, {escaped("text")})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, {escaped("text")}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({len(TURN) + len(BODY) + len(END)} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM c GROUP BY conv_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {lower(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS size, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS least FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS INTEGER), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM d
"""
