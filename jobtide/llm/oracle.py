"""SQL with the same results for the operators that SQL can express."""

from __future__ import annotations

import string

#: Space and U+0009 to U+000D, as a DuckDB expression.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {}

ORACLE["op6_line_dedup"] = f"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_SPACES}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM cut
), shared AS (
  SELECT key, max(doc_id) AS last_id
  FROM keyed
  WHERE length(key) >= 40
  GROUP BY key
  HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id,
       count(*) AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id <> s.last_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE s.key IS NULL OR k.doc_id = s.last_id), '')) AS kept_sha256
FROM keyed AS k LEFT JOIN shared AS s ON k.key = s.key
GROUP BY k.doc_id
"""

ORACLE["op10_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
              FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || role || '></turn>')
                + length(replace(replace(text, '\', '\\'), '<', '\<'))) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS attachment_tokens
FROM turns
GROUP BY conv_id
"""

#: Terms of a search: runs of ASCII letters, digits and all characters beyond ASCII.
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"unnest(regexp_extract_all({lower}, '{_TERMS}'))"


ORACLE["op11_lexical_search"] = f"""
WITH words AS (SELECT doc_id, {_terms("text")} AS term FROM documents),
items AS (SELECT DISTINCT item_id, {_terms("text")} AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM lengths),
counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, total GROUP BY term
),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), total
  GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE["op12_exact_top_k"] = """
WITH kept AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM kept AS q JOIN kept AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE["op13_filter_audit"] = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
firsts AS (SELECT t, min(doc_id) AS first_id FROM base GROUP BY t),
marked AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN base.doc_id > first_id THEN 16 ELSE 0 END AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n
  FROM base JOIN firsts USING (t) LEFT JOIN labels USING (doc_id)
  GROUP BY ALL
),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INTEGER) AS now,
         CAST(list_sum(bits[1:step]) AS INTEGER) - bits[step] AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
),
audit AS (
  SELECT part, filter_order, step, bit,
         CAST(coalesce(sum(n) FILTER (fails & now = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0 AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0 AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM marked, steps GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM audit
"""
