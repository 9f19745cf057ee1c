"""SQL twins of training-data queries, stated independently of the operators."""

from __future__ import annotations

_WORDS = (
    "list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

#: Every window of every document against every window of every item.
WINNOWING = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM docs, lens, unnest(range(1, len(w) - n + 2)) AS u(s)),
hit AS (SELECT DISTINCT r, s, n, item FROM dw JOIN win USING (k, n)),
pos AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT r, s, n FROM hit), unnest(range(s, s + n)) AS v(p) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

#: The cheapest repair by dynamic programming over (rows used, state), one row of all conversations a round.
REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS code
  FROM conversations),
marked AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(code, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM named, crc),
spoilt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS x(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ending
  FROM spoilt),
faulty AS (
  SELECT *, left(role, 1) AS ini,
    CASE WHEN ending = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
conv AS (
  SELECT conv_id, count(*) AS n, list(ini ORDER BY i) AS inis, list(fault ORDER BY i) AS faults,
    list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- States: 0 nothing written, 1 system, 2 user, 3 full exchange.  Inserts that lead from a state to another.
ins(st, mid, c, a) AS (VALUES
  (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'),
  (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (2, 2, 6, 'II'), (3, 2, 3, 'I'), (3, 3, 6, 'II')),
edit(mid, st, ini, c, a) AS (VALUES
  (0, 0, NULL, 4, 'D'), (1, 1, NULL, 4, 'D'), (2, 2, NULL, 4, 'D'), (3, 3, NULL, 4, 'D'),
  (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'), (3, 2, 'u', 0, 'K'),
  (0, 2, NULL, 3, 'R'), (1, 2, NULL, 3, 'R'), (2, 3, NULL, 3, 'R'), (3, 2, NULL, 3, 'R')),
dp AS (
  SELECT conv_id, 0 AS i, 0 AS st, {'c': 0, 'a': ''} AS best FROM conv
  UNION ALL
  SELECT d.conv_id, d.i + 1, e.st,
    min({'c': d.best.c + ins.c + e.c + CASE WHEN e.a <> 'D' AND faults[d.i + 1] = 3 THEN 3 ELSE 0 END, 'a': d.best.a || ins.a || e.a})
  FROM dp d JOIN conv ON conv.conv_id IS NOT DISTINCT FROM d.conv_id JOIN ins ON ins.st = d.st JOIN edit e ON e.mid = ins.mid
  WHERE d.i < n AND (e.ini IS NULL OR e.ini = inis[d.i + 1]) AND (e.a = 'D' OR faults[d.i + 1] NOT IN (1, 2))
  GROUP BY d.conv_id, d.i, e.st),
done AS (
  SELECT conv.*, best.c AS cost, best.a AS audit FROM conv JOIN (
    SELECT d.conv_id, min({'c': d.best.c + ins.c, 'a': d.best.a || ins.a}) AS best
    FROM dp d JOIN conv c ON c.conv_id IS NOT DISTINCT FROM d.conv_id JOIN ins ON ins.st = d.st
    WHERE d.i = c.n AND ins.mid IN (0, 3) GROUP BY d.conv_id) b ON b.conv_id IS NOT DISTINCT FROM conv.conv_id),
steps AS (
  SELECT conv_id, roles, texts, inis, p, audit[p] AS e,
    length(replace(audit[1:p], 'I', '')) AS row, length(replace(audit[1:p], 'D', '')) AS written,
    inis[length(replace(left(audit, length(audit) - length(ltrim(audit, 'D')) + 1), 'I', ''))] = 's'
      AND left(ltrim(audit, 'D'), 1) = 'K' AS sys
  FROM done, unnest(range(1, length(audit) + 1)) AS t(p)),
written AS (
  SELECT conv_id, string_agg(
    CASE WHEN e = 'K' THEN roles[row] WHEN (written - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN e = 'I' THEN '' ELSE texts[row] END, chr(10) ORDER BY p) AS body
  FROM steps WHERE e <> 'D' GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN written ON written.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

ORACLES: dict[str, str] = {"op11_branch_and_bound": REPAIR, "op12_winnowing": WINNOWING}

#: All products of quantised vectors.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER w)::INT AS rank, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)
QUALIFY rank <= 5
"""

#: All pairs of documents that share a shingle, and what can be reached over their links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM docs, unnest(range(1, len(w))) AS t(i)
  UNION SELECT doc_id, w[1] FROM docs WHERE len(w) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS node FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT doc_id, min(node) AS m FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)
"""

ORACLES |= {"op1_impact_top_k": TOP_K, "op10_hyperminhash": NEAR_DUPLICATES}
