"""DuckDB SQL for the queries that SQL can express."""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS phrase
  FROM (SELECT item_id, w[s:s + 9] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0))
), sizes AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes)
), hits AS (
  SELECT d.doc_id, d.s, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.phrase = i.phrase
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
), places AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM docs
), counts AS (
  SELECT term, count(*) AS n FROM places GROUP BY term
), terms AS (
  SELECT item_id, phrase, unnest(string_split(phrase, ' ')) AS term, unnest(range(0, n)) AS place FROM item_windows
), ranked AS (
  SELECT t.item_id, t.phrase, t.term, coalesce(c.n, 0) AS n, row_number() OVER (PARTITION BY t.item_id, t.phrase ORDER BY coalesce(c.n, 0), t.place) AS r
  FROM terms t LEFT JOIN counts c USING (term)
), anchors AS (
  SELECT item_id, max(term) FILTER (WHERE r = 1) AS first, max(term) FILTER (WHERE r = 2) AS second FROM ranked GROUP BY item_id, phrase
), near AS (
  SELECT a.doc_id, count(DISTINCT x.item_id) AS n_near
  FROM (SELECT DISTINCT item_id, first, second FROM anchors) x JOIN places a ON a.term = x.first
  LEFT JOIN places b ON b.term = x.second AND b.doc_id = a.doc_id AND abs(a.pos - b.pos) <= 20 AND a.pos <> b.pos
  WHERE x.second IS NULL OR b.doc_id IS NOT NULL GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, coalesce(f.items_sha256, sha256('')) AS items_sha256,
  coalesce(w.n_hit, 0) > 0 AS contaminated, CAST(coalesce(n.n_near, 0) AS BIGINT) AS n_near
FROM docs d LEFT JOIN words w USING (doc_id) LEFT JOIN found f USING (doc_id) LEFT JOIN near n USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head
  FROM conversations WHERE conv_id IS NOT NULL
), rendered AS (
  SELECT *, head || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS whole FROM turns
), reply AS (
  SELECT conv_id, max(k) FILTER (WHERE role = 'assistant') AS at, conv_id + 1 - 2 * (((conv_id % 2) + 2) % 2) AS other FROM turns GROUP BY conv_id
), pairs AS (
  SELECT a.conv_id, a.at, a.at IS NOT NULL AND b.at IS NOT NULL AS paired, b.conv_id AS other, b.at AS other_at FROM reply a LEFT JOIN reply b ON a.other = b.conv_id
), own AS (
  SELECT p.conv_id, p.paired, p.at, x.whole AS reply, x.head AS reply_head, y.whole AS other_reply, y.head AS other_head,
    CASE WHEN p.paired THEN p.at - 1 + CASE WHEN x.text IS NOT DISTINCT FROM y.text THEN 1 ELSE 0 END ELSE 0 END AS prompt_turns
  FROM pairs p LEFT JOIN rendered x ON x.conv_id = p.conv_id AND x.k = p.at LEFT JOIN rendered y ON p.paired AND y.conv_id = p.other AND y.k = p.other_at
), placed AS (
  SELECT t.*, o.prompt_turns, sum(length(whole)) OVER (PARTITION BY t.conv_id, t.k <= o.prompt_turns ORDER BY t.k) AS stop
  FROM rendered t JOIN own o ON t.conv_id = o.conv_id WHERE o.at IS NULL OR t.k <= o.at
), chosen AS (
  SELECT conv_id, coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE k <= prompt_turns), '') AS prompt, coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE k > prompt_turns), '') AS chosen,
    coalesce(string_agg(CAST(CAST(stop - length(whole) + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k > prompt_turns AND role = 'assistant'), '') AS chosen_mask
  FROM placed GROUP BY conv_id
)
SELECT o.conv_id AS pair_id, o.paired, CAST(o.prompt_turns AS BIGINT) AS prompt_turns, c.prompt, c.chosen, c.chosen_mask,
  CASE WHEN o.paired AND o.prompt_turns < o.at THEN o.other_reply ELSE '' END AS rejected,
  CASE WHEN o.paired AND o.prompt_turns < o.at THEN length(o.other_head) || '-' || length(o.other_reply) ELSE '' END AS rejected_mask
FROM own o JOIN chosen c ON o.conv_id = c.conv_id
"""
