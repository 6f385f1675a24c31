"""DuckDB twins of the queries that SQL can express.

BPE, SimHash, sharding and the classifiers have none: SQL lacks the merges,
XXH64, CRC-32 and the fits. Their tests hold them against brute force.
"""

LINES = r"""
WITH numbered AS (
  SELECT doc_id, source, t.line, rtrim(t.line, chr(13)) AS bare, t.pos FROM documents,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) t),
bar AS (SELECT greatest(3, least(8, ceil(count(DISTINCT coalesce(source, chr(0) || 'none')) * 0.4))) AS sites FROM documents),
firsts AS (
  SELECT bare, min((doc_id, pos)) AS first FROM numbered
  WHERE regexp_matches(bare, '[^ \t\n\x0B\f\r]')
  GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(0) || 'none')) >= (SELECT sites FROM bar)),
marked AS (
  SELECT n.doc_id, n.pos, n.line, f.bare IS NOT NULL AND f.first <> (n.doc_id, n.pos) AS gone
  FROM numbered n LEFT JOIN firsts f ON n.bare = f.bare)
SELECT d.doc_id, coalesce(count(m.pos), 0) AS n_lines, coalesce(count(m.pos) FILTER (WHERE gone), 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT gone), '')) END AS text_sha256
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text
"""

URLS = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts))),
places AS (
  SELECT name, CASE WHEN regexp_full_match(name, '[0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\]') THEN name WHEN regexp_matches(name, '(^|[.])(ac|co|com|edu|gob|gov|go|ne|net|or|org)[.][a-z]{2}$') THEN regexp_extract(name, '([^.]*[.])?[^.]*[.][^.]*$') ELSE regexp_extract(name, '([^.]*[.])?[^.]*$') END AS domain,
    CASE WHEN regexp_full_match(name, '[0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\]') THEN name WHEN regexp_matches(name, '(^|[.])(ac|co|com|edu|gob|gov|go|ne|net|or|org)[.][a-z]{2}$') THEN regexp_extract(name, '[^.]*[.][^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix
  FROM (SELECT DISTINCT name FROM split)),
rules(what, rule, name, start) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
ruled AS (
  SELECT s.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.what, length(r.rule)) AS what
  FROM split s JOIN rules r ON (s.host = r.name OR ends_with(s.host, '.' || r.name)) AND starts_with(s.path, r.start) GROUP BY s.page_id),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT s.page_id, s.name, max(b.bad) AS bad FROM split s JOIN bad b ON b.bad IS NOT NULL AND b.doc_id = TRY_CAST(regexp_extract(s.path, '/([0-9]{1,18})', 1) AS BIGINT) GROUP BY ALL),
hosts AS (
  SELECT name AS host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM outcomes JOIN places USING (name) GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1.0) ELSE 0.0 END::DOUBLE AS p FROM hosts),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, (SELECT p FROM overall) AS prior FROM hosts GROUP BY suffix),
sw AS (SELECT sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior)), 0) AS x FROM s0 WHERE n > 1),
sk AS (SELECT CASE WHEN x > 0 THEN least(200.0, greatest(2.0, 1 / x - 1)) ELSE 200.0 END AS k FROM sw),
s1 AS (SELECT suffix, (bad + prior * k) / (n + k) AS mean, n + k AS weight FROM s0, sk),
d0 AS (SELECT domain, h.suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(s1.mean) AS prior FROM hosts h JOIN s1 ON s1.suffix = h.suffix GROUP BY ALL),
dw AS (SELECT sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior)), 0) AS x FROM d0 WHERE n > 1),
dk AS (SELECT CASE WHEN x > 0 THEN least(200.0, greatest(2.0, 1 / x - 1)) ELSE 200.0 END AS k FROM dw),
d1 AS (SELECT domain, (bad + prior * k) / (n + k) AS mean, n + k AS weight FROM d0, dk),
h0 AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, d1.mean AS prior FROM hosts h JOIN d1 ON d1.domain = h.domain),
hw AS (SELECT sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) / nullif(sum(n * prior * (1 - prior)), 0) AS x FROM h0 WHERE n > 1),
hk AS (SELECT CASE WHEN x > 0 THEN least(200.0, greatest(2.0, 1 / x - 1)) ELSE 200.0 END AS k FROM hw),
h1 AS (SELECT host, (bad + prior * k) / (n + k) AS mean, n + k AS weight FROM h0, hk),
judged AS (
  SELECT s.*, coalesce(h1.mean, d1.mean, s1.mean, (SELECT p FROM overall)) AS m, coalesce(h1.weight, d1.weight, s1.weight, 2.0) AS w
  FROM split s JOIN places p USING (name) LEFT JOIN h1 ON h1.host = s.name LEFT JOIN d1 ON d1.domain = p.domain LEFT JOIN s1 ON s1.suffix = p.suffix)
SELECT j.page_id, j.host, j.path, r.rule,
  coalesce(r.what, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ruled r USING (page_id)
"""

CHAT = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
shaped AS (
  SELECT *, length(text) - length(replace(text, '\\', '')) AS slashes,
    (length(text) - length(replace(text, '###', ''))) // 3 AS hashes, (length(text) - length(replace(text, '</turn>', ''))) // 7 AS ends
  FROM rows),
sized AS (
  SELECT *, 13 + length(role) + length(text)
    + CASE WHEN hashes + ends > 0 OR contains(text, '\\\\') OR ends_with(text, '\\') THEN slashes + hashes + ends ELSE 0 END AS size FROM shaped)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

TOPK = """
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
codes AS (SELECT row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS c FROM sound),
scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, d.vec_id, list_dot_product(q.c, d.c)::BIGINT AS score
  FROM codes q JOIN codes d ON q.vec_id % 20 = 0 AND d.row <> q.row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""



def _centroids(k: int, rounds: int) -> str:
    """Rounds of clustering, one after another; all numbers are whole and below 2^53, so doubles hold them."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, arg_min(n, (d, n)) AS n, min(d) AS d FROM (
    SELECT x.row, c.n, list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v) AS d FROM kept x, c{r} c) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT n, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY i) AS v FROM (
      SELECT a.n, p.i, sum(p.x)::BIGINT AS s, count(*) AS m FROM a{r} a JOIN parts p USING (row) GROUP BY a.n, p.i) GROUP BY n) m USING (n))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, unnest(range(64)) AS i, unnest(v)::BIGINT AS x FROM kept),
c0 AS MATERIALIZED (SELECT n, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS n, v FROM kept WHERE vec_id IS NOT NULL) WHERE n < {k}),
{", ".join(steps)}
SELECT x.vec_id, a.n::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept x USING (row) JOIN c{rounds} c USING (n)
"""


SQL = {"op12_centroids": _centroids(40, 5), "op5_line_dedup": LINES, "op6_url_filters": URLS, "op7_chat": CHAT, "op10_topk": TOPK}
