"""DuckDB SQL for the queries that SQL can express in full."""


def _product_codes(rounds: int = 6) -> str:
    """Whole scans in each round, where the operator looks at moved entries only."""
    near = """SELECT r, p, min({{'d': d, 'e': e}}) AS m, any_value(v) AS v FROM (
      SELECT x.r, x.p, x.v, c.e, list_sum([(x.v[i] - c.c[i]) * (x.v[i] - c.c[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT AS d FROM x JOIN c{0} c USING (p)) GROUP BY r, p"""
    steps = [
        f"""a{k} AS MATERIALIZED ({near.format(k)}),
n{k} AS (SELECT p, e, i, sum(n) AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS n FROM a{k}) GROUP BY p, e, i),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT p, e, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM n{k} GROUP BY p, e) n USING (p, e))"""
        for k in range(rounds)
    ]
    return f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(x::DOUBLE * 4096)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
v AS (SELECT * FROM q WHERE len(q) = (SELECT len(q) FROM q WHERE len(q) > 0 AND len(q) % 8 = 0 ORDER BY r LIMIT 1)),
x AS MATERIALIZED (SELECT r, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM v CROSS JOIN range(8) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e, v AS c FROM x WHERE r IN (SELECT r FROM v ORDER BY r LIMIT 16)),
{", ".join(steps)},
z AS MATERIALIZED ({near.format(rounds)}),
o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY r)
SELECT v.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN o USING (r)"""


ORACLES = {
    "op2_url_filters": r"""
WITH rules(verdict, h, p) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
u AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
m AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT * FROM u) JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p)
  GROUP BY page_id, host, path)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id IS NOT DISTINCT FROM m.page_id AND u.host = m.host AND u.path = m.path""",
    "op5_decontamination": r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS words FROM documents),
b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS words FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(list_slice(words, pos, pos + least(10, len(words)) - 1), ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos FROM b WHERE len(words) > 0)),
d AS (
  SELECT r, pos, k, array_to_string(list_slice(words, pos, pos + k - 1), ' ') AS gram
  FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS pos FROM w CROSS JOIN (SELECT DISTINCT k FROM g) WHERE len(words) >= k)),
h AS (SELECT r, pos, d.k, item_id FROM d JOIN g ON d.gram = g.gram AND d.k = g.k),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT r, pos, k FROM h)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN i USING (r)""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f""",
    # states: nothing yet, after system, after user, after assistant; every state keeps its cheapest, ASCII-least edits
    "op11_conversation_repair": r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
sums(key, i, c) AS (
  SELECT DISTINCT key, 0, 4294967295::BIGINT FROM keyed
  UNION ALL SELECT key, i + 1, xor(s.c >> 8, b.c) FROM sums s JOIN bits b ON b.k = 8 AND b.b = xor(s.c, ascii(substr(key, i + 1, 1))) & 255 WHERE i < length(key)),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(c, 4294967295) % 20 AS d FROM keyed JOIN sums USING (key) WHERE i = length(key)),
rows_ AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR d = 3 WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM rows_),
r AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
inserts(a, m, n, lines) AS (VALUES
  (0, 0, 0, ''), (0, 2, 1, chr(10) || 'user:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, ''), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, ''), (2, 3, 1, chr(10) || 'assistant:'), (3, 3, 0, ''), (3, 2, 1, chr(10) || 'user:')),
edits(m, z, kind, initial, cost, role) AS (VALUES
  (0, 0, 'D', '', 3, ''), (1, 1, 'D', '', 3, ''), (2, 2, 'D', '', 3, ''), (3, 3, 'D', '', 3, ''), (0, 1, 'K', 's', 0, ''), (0, 2, 'K', 'u', 0, ''), (1, 2, 'K', 'u', 0, ''), (3, 2, 'K', 'u', 0, ''), (2, 3, 'K', 'a', 0, ''),
  (0, 2, 'R', 'u', 2, 'user'), (1, 2, 'R', 'u', 2, 'user'), (3, 2, 'R', 'u', 2, 'user'), (2, 3, 'R', 'a', 2, 'assistant')),
dp(conv_id, n, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'body': ''} FROM conversations
  UNION ALL
  SELECT d.conv_id, r.n, e.z, min({'cost': d.best.cost + 2 * i.n + e.cost + CASE WHEN e.kind <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
    'audit': d.best.audit || repeat('I', i.n) || e.kind, 'body': d.best.body || i.lines || CASE e.kind WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || e.role || ':' || r.text END})
  FROM dp d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n + 1 JOIN inserts i ON i.a = d.state
  JOIN edits e ON e.m = i.m AND (e.kind = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (e.kind = 'R' OR e.initial = r.initial))
  GROUP BY d.conv_id, r.n, e.z),
f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
w AS (
  SELECT d.conv_id, min({'cost': d.best.cost + 2 * i.n, 'audit': d.best.audit || repeat('I', i.n), 'body': d.best.body || i.lines}) AS best
  FROM dp d LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id JOIN inserts i ON i.a = d.state AND i.m IN (0, 3) WHERE d.n = coalesce(f.n, 0) GROUP BY d.conv_id)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(substr(best.body, 2)) AS repaired_sha256
FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id""",
    "op13_vector_codes": _product_codes(),
}
