"""DuckDB twins of the catalog's queries, from shared common table expressions."""

from __future__ import annotations

from corpusmith import corpus
from corpusmith.functions import text as tx
from corpusmith.functions.sequential import config_hash
from corpusmith.operators import middleware
from corpusmith.operators import retrieval as r


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _tokens(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({col}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


ASKED = sorted({(q, w) for q, t in corpus.QUERIES for w in r._words(t)})

CENTROIDS = """centroids AS (
  SELECT label AS query_id, list(m ORDER BY i) AS vector FROM (
    SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""

DENSE_ALL = f"""{CENTROIDS},
dense_all AS (
  SELECT c.query_id, e.vec_id AS chunk_id,
    list_dot_product(e.embedding::DOUBLE[], c.vector) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(c.vector, c.vector))) AS score
  FROM embeddings e, centroids c WHERE e.embedding IS NOT NULL),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dense_all),
dense40 AS (SELECT * FROM dense_ranked WHERE rank <= {r.CANDIDATES}), dense10 AS (SELECT * FROM dense_ranked WHERE rank <= {r.RESULTS})"""

COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"

LEX_ALL = f"""asked(query_id, term) AS (VALUES {_values((q, _text(w)) for q, w in ASKED)}),
words AS (SELECT doc_id AS chunk_id, {_tokens('text')} AS words FROM documents),
sizes AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM words),
held AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(words) AS length, unnest(words) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM held GROUP BY term),
lex_all AS (
  SELECT a.query_id, h.chunk_id, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * h.tf * {r.K1 + 1} / (h.tf + {r.K1} * (1 - {r.B} + {r.B} * h.length / s.mean_length))) AS score
  FROM held h JOIN dfs d USING (term) JOIN asked a USING (term), sizes s GROUP BY ALL),
lex40 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lex_all) WHERE rank <= {r.CANDIDATES})"""

BOTH = f"{DENSE_ALL}, {LEX_ALL}"


def _fused(name: str, dense: str, lex: str) -> str:
    return f"""{name} AS (
  SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / ({r.RRF_K} + d.rank), 0) + coalesce(1.0::DOUBLE / ({r.RRF_K} + x.rank), 0) AS score
  FROM {dense} d FULL OUTER JOIN {lex} x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id)"""


def _top(name: str, rows: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {rows}) WHERE rank <= {k})"


FUSED = f"{BOTH}, {_fused('fused', 'dense40', 'lex40')}, {_top('fused10', 'fused', r.RESULTS)}"
RANKED = "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM "

GATED = f"""{FUSED}, passed AS (SELECT query_id FROM dense10 GROUP BY query_id HAVING count(*) >= 5 AND max(score) >= 0.5),
gated AS (SELECT query_id, chunk_id, score, 'dense' AS match_source FROM dense10 WHERE query_id IN (SELECT * FROM passed)
  UNION ALL SELECT query_id, chunk_id, score, 'hybrid' FROM fused10 WHERE query_id NOT IN (SELECT * FROM passed))"""

EDGES = """edges(src, dst, relation) AS (
  SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'contains' FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier),
links AS (SELECT doc_id AS chunk_id, 'n' || (doc_id % 25) AS concept, 0.5::DOUBLE + (doc_id % 5)::DOUBLE / 10 AS confidence FROM documents)"""


def _walk(edges: str, roots: str, hops: int) -> str:
    return f"""steps AS (SELECT DISTINCT src, dst FROM {edges}),
walk AS (
  SELECT query_id, concept, 0 AS depth, [concept] AS path FROM {roots}
  UNION ALL SELECT w.query_id, s.dst, w.depth + 1, list_append(w.path, s.dst) FROM walk w JOIN steps s ON s.src = w.concept
  WHERE w.depth < {hops} AND NOT list_contains(w.path, s.dst)),
reached AS (SELECT query_id, concept, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY query_id, concept)"""


SEEDS = f"seeds AS (SELECT DISTINCT f.query_id, l.concept FROM (SELECT * FROM fused10 WHERE rank <= {5}) f JOIN links l USING (chunk_id))"

QRELS = "qrels AS (SELECT e.label AS query_id, e.vec_id AS chunk_id, 1 + coalesce(l.quality, 0) AS rel FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id)"


def _metrics(name: str, ranked: str) -> str:
    return f"""{name}_ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (2.0::DOUBLE ** rel - 1) / log2(place + 1.0::DOUBLE) ELSE 0 END) AS ideal, count(*) FILTER (WHERE rel > 0) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS place FROM qrels) GROUP BY query_id),
{name}_hits AS (SELECT query_id, sum((2.0::DOUBLE ** rel - 1) / log2(rank + 1.0::DOUBLE)) AS dcg, count(*) FILTER (WHERE rel > 0) AS found, min(rank) FILTER (WHERE rel > 0) AS first
  FROM {ranked} JOIN qrels USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY query_id),
{name} AS (SELECT i.query_id, coalesce(dcg / nullif(ideal, 0), 0) AS ndcg, coalesce(found::DOUBLE / nullif(relevant, 0), 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, first
  FROM {name}_ideal i LEFT JOIN {name}_hits h USING (query_id))"""


MARKDOWN = """marked AS (SELECT doc_id, '# ' || coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '## Source' || chr(10) || chr(10) || coalesce(source, '') AS text FROM documents)"""


def _html() -> str:
    out = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>', '', 'g')"
    for level in range(1, 7):
        out = rf"regexp_replace({out}, '(?i)<h{level}(\s[^>]*)?>', chr(10) || '{'#' * level} ', 'g')"
    out = f"regexp_replace({out}, '(?i)</p>|<br ?/?>|</div>|</li>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '(?i)<li(\s[^>]*)?>', '- ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{entity}', '{plain}')"
    return f"trim({out}, ' ')"


def _canonical(col: str) -> str:
    bare = rf"regexp_replace(lower(trim(regexp_replace(strip_accents(coalesce({col}, '')), '[^\x00-\x7F]', '', 'g'), ' ')), '^(doc(ument)?[_:\-\s]+)?(chunk[_:\-\s]+)?', '')"
    pieces = rf"list_filter(regexp_split_to_array(regexp_replace({bare}, '[^a-z0-9#._\-\s/|:]', '', 'g'), '[\s/|:\-]+'), lambda x: x <> '')"
    return rf"regexp_replace(array_to_string({pieces}, '-'), '^[\-_.]+|[\-_.]+$', '', 'g')"


def _context(rows: str, key: str, text: str) -> str:
    """(key, plain) of rows: distinct sentences."""
    steps = ((r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", "''"), (r"\[([^\]]+)\]\(([^)]+)\)", r"'\1 (\2)'"), (tx.HEADS, "''"), (tx.QUOTES, "''"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''"), (r"([.!?])\s+", r"'\1' || chr(1)"))
    out = f"coalesce({text}, '')"
    for pattern, put in steps:
        out = f"regexp_replace({out}, '{pattern}', {put}, 'g')"
    return rf"""sentences AS (SELECT {key}, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT {key}, string_split({out}, chr(1)) AS s FROM {rows})),
marked AS (SELECT *, trim(lower(regexp_replace(x, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ') AS words FROM sentences),
kept AS (SELECT {key}, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM marked QUALIFY words = '' OR row_number() OVER (PARTITION BY {key}, words ORDER BY i) = 1),
plains AS (SELECT {key}, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE x <> ''), '') AS plain FROM kept GROUP BY {key})"""


def _quality(content: str, n: str) -> str:
    return f"round(greatest(0, least(1, 0.25 + 0.15 + 0.10 * 0.9 + 0.15 * (CASE WHEN contains({content}, '```') THEN 1.0 ELSE 0.9 END) + 0.15 * (CASE WHEN {n} BETWEEN 50 AND 480 THEN 1.0 ELSE 0.7 END) + 0.10 + 0.10)), 4)::DOUBLE"


def _chunk_id(doc: str, order: str, content: str) -> str:
    return f"sha256({doc} || ':' || {order} || ':' || sha256({content}))"


def _sanitize() -> str:
    step = r"trim(regexp_replace(regexp_replace(trim(coalesce(text, ''), ' '), '[`{}\[\]<>|\\]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
    return f"SELECT doc_id, CASE WHEN length(q) > 200 THEN rtrim(substr(q, 1, 197), ' ') || '...' ELSE q END AS query FROM (SELECT doc_id, {step} AS q FROM documents)"


def _error_case() -> str:
    whens = " ".join(
        "WHEN " + " OR ".join("(" + " AND ".join(f"contains(e, '{s}')" for s in way) + ")" for way in ways) + f" THEN '{name}'" for name, ways in tx.ERRORS
    )
    return f"CASE {whens} ELSE 'invalid_benchmark_row' END"


def build() -> dict[str, str]:
    from corpusmith.plans import catalog as c

    questions = ", ".join(map(_text, c.QUESTIONS))
    errors = ", ".join(map(_text, c.ERROR_TEXTS))
    asked = f"SELECT conv_id, turn, concat_ws(' ', text, ([{questions}])[turn % {len(c.QUESTIONS)} + 1]) AS query FROM conversations"
    terms = sorted({w for _, t in corpus.QUERIES for w in t.lower().split()} - {"not"})
    wordy = r"(?i)(?:^|\s+)(?:NOT|without|except|sans)\s+([A-Za-z0-9_\-]+)"
    dashed = r"(?:^|\s+)-([A-Za-z0-9_\-]+)"
    relational = tx.any_pattern(tx.RELATIONAL)
    steps = ";".join(f"{x.name}:{x.version}:{config_hash(x.settings)}" for x in (middleware.CONTENTS, middleware.LINKS))
    named = r"""WITH names AS (SELECT DISTINCT lower(CASE WHEN b = '' THEN trim(a) ELSE b END) AS low FROM (
  SELECT a, trim(regexp_replace(a, '^[0-9.\-\s]+|^[#*_`\s]+|[#*_`\s]+$', '', 'g')) AS b FROM (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS a FROM benchmark)) WHERE length(CASE WHEN b = '' THEN trim(a) ELSE b END) >= 3),
said AS (SELECT doc_id, low FROM documents JOIN names ON contains(lower(text), low))"""
    tenant = f"CAST(substr(source, 4) AS INT) % {corpus.TENANTS}"
    scoped = f"""{BOTH}, owned AS (SELECT q.query_id, d.doc_id AS chunk_id FROM (VALUES {_values((q, q % corpus.TENANTS) for q, _ in corpus.QUERIES)}) q(query_id, tenant) JOIN documents d ON {tenant} = q.tenant),
d_own AS (SELECT query_id, chunk_id, score FROM dense_all JOIN owned USING (query_id, chunk_id)), x_own AS (SELECT query_id, chunk_id, score FROM lex_all JOIN owned USING (query_id, chunk_id)),
{_top('d_top', 'd_own', r.CANDIDATES)}, {_top('x_top', 'x_own', r.CANDIDATES)}, {_fused('fused', 'd_top', 'x_top')}, {_top('fused10', 'fused', r.RESULTS)}"""
    blended = f"""{BOTH}, blended AS (SELECT x.query_id, x.chunk_id, x.score + 0.5 * {r.RECENCY_DAYS}::DOUBLE / (d.doc_id % 365 + {r.RECENCY_DAYS}) + 0.3 * coalesce(l.quality, 0) AS score
  FROM lex_all x JOIN documents d ON d.doc_id = x.chunk_id LEFT JOIN labels l ON l.doc_id = x.chunk_id),
{_top('b40', 'blended', r.CANDIDATES)}, {_fused('fused', 'dense40', 'b40')}, {_top('fused10', 'fused', r.RESULTS)}"""
    zero = f"""{BOTH}, zero AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id)::VARCHAR AS id,
    1.0::DOUBLE / ({r.RRF_K} + coalesce(d.rank - 1, {r.ABSENT})) + 1.0::DOUBLE / ({r.RRF_K} + coalesce(x.rank - 1, {r.ABSENT})) AS score
  FROM dense40 d FULL OUTER JOIN lex40 x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id)"""
    zero_out = "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id)::INT AS rank, round(score, 9) AS score FROM "
    graph = f"{FUSED}, {EDGES}, {SEEDS}, {_walk('edges', 'seeds', 1)}, scores AS (SELECT query_id, chunk_id, max(confidence / (1.0 + depth)) AS g FROM reached JOIN links USING (concept) GROUP BY ALL)"
    graph += f", merged AS (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.chunk_id, s.chunk_id) AS chunk_id, coalesce(f.score, 0) + {r.GRAPH_WEIGHT} * coalesce(g, 0) / {r.RRF_K} AS score FROM fused f FULL OUTER JOIN scores s ON f.query_id = s.query_id AND f.chunk_id = s.chunk_id), {_top('best', 'merged', r.RESULTS)}"
    summed = f"{FUSED}, {EDGES}, {SEEDS}, two AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), {_walk('two', 'seeds', 2)}, scores AS (SELECT query_id, chunk_id, sum({r.GRAPH_WEIGHT}::DOUBLE / ({r.RRF_K} + depth)) AS g FROM reached JOIN links USING (concept) WHERE depth > 0 GROUP BY ALL)"
    summed += f", merged AS (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.chunk_id, s.chunk_id) AS chunk_id, coalesce(f.score, 0) + coalesce(g, 0) AS score FROM fused f FULL OUTER JOIN scores s ON f.query_id = s.query_id AND f.chunk_id = s.chunk_id), {_top('best', 'merged', r.RESULTS)}"
    toc = _text(c.TOC + "\n").replace("\n", "' || chr(10) || '")
    name = r"trim(regexp_replace('## ' || url || ' **', '^[0-9.\-\s]+|^[#*_`\s]+|[#*_`\s]+$', '', 'g'), ' ')"
    url_parts = r"lower(regexp_extract(url, '^([^:/?#]*)', 1)) || regexp_extract(url, '^[^:/?#]*([^?#]*)', 1) AS head, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '(#.+)$', 1) AS tail"
    # Parameters of one name stand together where the first of them stood.
    together = "list_transform(list_sort(list_transform(kept, lambda x, i: {'first': list_position(list_transform(kept, lambda y: string_split(y, '=')[1]), string_split(x, '=')[1]), 'at': i, 'x': x})), lambda r: r.x)"
    tracking = ", ".join(f"'{t}'" for t in tx.TRACKING)
    jobs = "WITH jobs AS (SELECT user_id AS job, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' ELSE 'complete' END AS status, ts AS \"at\" FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
    return {
        "dense_top10": f"WITH {DENSE_ALL} {RANKED} dense10",
        "dense_rows_top10": f"SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 9) DESC, e.vec_id)::INT AS rank, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= {r.RESULTS}",
        "bm25_top40": f"WITH {LEX_ALL} {RANKED} lex40",
        "fts_and_match": f"WITH words AS (SELECT doc_id, {_tokens('text')} AS words FROM documents), q(query_id, wanted) AS (VALUES {_values((k, '[' + ', '.join(map(_text, r._words(t))) + ']') for k, t in corpus.QUERIES)}) SELECT query_id, count(*) AS n, min(doc_id) AS first_chunk FROM words, q WHERE list_has_all(words, wanted) GROUP BY query_id",
        "hybrid_rrf_sql": f"WITH {FUSED} {RANKED} fused10",
        "hybrid_rrf_scoped": f"WITH {scoped} {RANKED} fused10",
        "hybrid_rrf_attr": f"WITH {blended} {RANKED} fused10",
        "rrf_zero_based": f"WITH {zero} {zero_out} zero",
        "rrf_negation": f"WITH {zero}, cut AS (SELECT z.query_id, z.id, CASE WHEN z.query_id IN ({', '.join(str(q) for q, _ in corpus.QUERIES)}) AND contains(lower(coalesce(d.text, z.id)), 'aning') THEN z.score * 0.5 ELSE z.score END AS score FROM zero z LEFT JOIN documents d ON d.doc_id::VARCHAR = z.id) {zero_out} cut",
        "negation_partition": f"WITH {FUSED} SELECT f.query_id, f.chunk_id, round((2.0::DOUBLE / ({r.RRF_K} + rank - 1)) * CASE WHEN contains(lower(d.text), 'onble') THEN 0.5 ELSE 1 END, 9) AS score FROM fused10 f JOIN documents d ON d.doc_id = f.chunk_id",
        "dense_gate_union": f"WITH {GATED} SELECT query_id, chunk_id, match_source, round(score, 6) AS score FROM gated",
        "crag_tiers": f"WITH {GATED}, best AS (SELECT query_id, max(score) FILTER (WHERE match_source = 'dense') AS d, max(score) AS s FROM gated GROUP BY query_id) SELECT query_id, CASE WHEN d IS NOT NULL THEN CASE WHEN d < 0.55 THEN 'low' WHEN d < 0.7 THEN 'medium' ELSE 'high' END WHEN s < 0.012 THEN 'low' WHEN s < 0.020 THEN 'medium' ELSE 'high' END AS tier FROM best",
        "rerank_overlap": f"WITH {FUSED}, q(query_id, wanted) AS (VALUES {_values((k, '[' + ', '.join(map(_text, sorted(set(r._words(t))))) + ']') for k, t in corpus.QUERIES)}), s AS (SELECT f.query_id, f.chunk_id, 8.0::DOUBLE * len(list_intersect(wanted, {_tokens('d.text')})) / len(wanted) - 4 AS score FROM fused10 f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id), {_top('best', 's', 5)} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS rerank_score FROM best",
        "litm_order": f"WITH {FUSED} SELECT query_id, chunk_id, CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE count(*) OVER (PARTITION BY query_id) - 1 - (rank - 2) // 2 END::BIGINT AS slot FROM fused10",
        "router_hops": f"SELECT conv_id, turn, CASE WHEN regexp_matches(trim(query), {_text(relational)}) THEN 1 ELSE 0 END AS hops FROM ({asked})",
        "negation_parse": f"WITH s AS (SELECT conv_id, turn, query, regexp_replace(query, {_text(wordy)}, ' ', 'g') AS a FROM ({asked})), t AS (SELECT *, trim(regexp_replace(regexp_replace(a, {_text(dashed)}, ' ', 'g'), '\\s+', ' ', 'g')) AS b, list_concat(regexp_extract_all(query, {_text(wordy)}, 1), regexp_extract_all(a, {_text(dashed)}, 1)) AS n FROM s) SELECT conv_id, turn, CASE WHEN b = '' THEN trim(query) ELSE b END AS cleaned, coalesce(array_to_string(list_filter(list_transform(n, lambda x: lower(x)), lambda x, i: list_position(list_transform(n, lambda y: lower(y)), x) = i), ','), '') AS negatives FROM t",
        "sanitize_queries": _sanitize(),
        "tenant_scope": f"SELECT source AS collection, count(*) AS n_chunks, sum(length(text))::BIGINT AS chars FROM documents WHERE {tenant} = 1 GROUP BY source",
        "star_join": f"SELECT ({tenant})::INT AS tenant, source AS collection, count(*) AS n, count(DISTINCT label) AS n_labels FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY ALL",
        "coverage_counts": "SELECT source AS collection, count(*) AS n, count(embedding) AS n_embedded, count(*) - count(embedding) AS n_missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source",
        "graph_traverse": f"WITH RECURSIVE {EDGES}, roots AS (SELECT 0 AS query_id, 'r' || r_regionkey AS concept FROM region), {_walk('edges', 'roots', c.TRADE_HOPS)} SELECT concept, depth, array_to_string(path, '>') AS path FROM reached",
        "graph_lineage": f"WITH RECURSIVE {EDGES}, roots AS (SELECT 0 AS query_id, 's' || min(s_suppkey) AS concept FROM supplier), {_walk('edges', 'roots', 1)} SELECT DISTINCT e.src, e.dst, e.relation, depth FROM reached JOIN edges e ON e.src = concept",
        "graph_rrf": f"WITH RECURSIVE {graph} {RANKED} best",
        "graph_bench_sum": f"WITH RECURSIVE {summed} {RANKED} best",
        "link_counts": "SELECT 'n' || (doc_id % 25) AS concept, count(*) AS n, 0.9::DOUBLE AS confidence FROM documents GROUP BY 1",
        "neighbors_window": "WITH a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'system' OR turn = 3) SELECT c.conv_id, a.turn AS anchor, c.turn, c.role FROM conversations c JOIN a ON a.conv_id = c.conv_id AND c.turn BETWEEN a.turn - 2 AND a.turn + 2",
        "concept_ilike": "SELECT '### Concept: ' || n_name || ' (nation)' || chr(10) || 'A nation.' AS content, 1.0::DOUBLE AS score, 'concept:' || n_name AS source_url FROM nation WHERE n_name ILIKE '%an%' OR n_name ILIKE '%1%' ORDER BY n_name LIMIT 4",
        "title_mentions": f"SELECT entity, count(*) AS n FROM documents, (VALUES {_values((_text(t),) for t in terms)}) v(entity) WHERE contains(lower(text), entity) GROUP BY entity",
        "hash_embedding": "WITH w AS (SELECT doc_id, sha256(word) AS h FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> ''), s AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 768 AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM w GROUP BY ALL) SELECT * FROM (SELECT doc_id, dim, round(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0), 8) AS x FROM s) WHERE x <> 0",
        "chunk_simple": f"WITH {MARKDOWN}, p AS (SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10) || '## ', chr(1) || '## '), chr(1)) AS c FROM marked)), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, trim(regexp_extract(content, '^#+ ([^\\n]*)', 1), ' ') AS title FROM p WHERE trim(content, ' ') <> '') SELECT doc_id, doc_id || '#c' || lpad(k::VARCHAR, 3, '0') AS chunk_id, CASE WHEN title = '' THEN 'Overview' ELSE title END AS section, length(rtrim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))::INT AS chars FROM t",
        "chunk_ids_quality": f"SELECT doc_id, n AS token_count, {_chunk_id('doc_id', '0', 'text')} AS chunk_id, {_quality('text', 'n')} AS quality, substr(sha256(doc_id || '::' || source), 1, 24) AS short_id FROM (SELECT *, greatest(1, length(text) // 4)::INT AS n FROM documents WHERE text IS NOT NULL)",
        "parse_confidence": "WITH l AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x, ' ') <> '') AS lines FROM documents) SELECT doc_id, (CASE WHEN length(trim(coalesce(text, ''), ' ')) < 50 THEN 0.5 ELSE least(1.0, round(0.7 + CASE WHEN len(list_filter(lines, lambda x: starts_with(x, '#'))) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(lines) > 5 THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '```') THEN 0.1 ELSE 0 END, 2)) END)::DOUBLE AS confidence FROM l",
        "html_to_markdown": f"SELECT page_id, {_html()} AS markdown FROM pages",
        "toc_strip": rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({toc} || text, '(?m)(?:^[ \t]*(?:\*|-|\d+\.)\s*\[.+?\]\(#.+?\)\s*\n){{3,}}', chr(10), 'g'), '(?mi)^#{{1,4}}\s+(Table of Contents|Contents|TOC|Index)\s*$\n?', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents",
        "middleware_chain": rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace({toc} || text, '(?m)(?:^[ \t]*(?:\*|-|\d+\.)\s*\[.+?\]\(#.+?\)\s*\n){{3,}}', chr(10), 'g'), '(?mi)^#{{1,4}}\s+(Table of Contents|Contents|TOC|Index)\s*$\n?', '', 'g'), '^\s+|\s+$', '', 'g')) AS text_sha256, 2 AS n_steps, sha256('{steps}') AS digest FROM documents",
        "url_params_clean": f"WITH p AS (SELECT page_id, url, {url_parts} FROM pages), k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: regexp_extract(x, '^[^=]*=(.*)$', 1) <> '' AND lower(string_split(x, '=')[1]) NOT IN ({tracking})) AS kept FROM p) SELECT page_id, head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string({together}, '&') ELSE '' END || tail AS url FROM k",
        "canonical_ids": f"SELECT page_id, {_canonical(chr(39) + ' Document:' + chr(39) + ' || url')} AS id, {name} AS name FROM pages",
        "context_normalize": f"WITH {_context('documents', 'doc_id', 'text')}, c AS (SELECT doc_id, plain, rtrim(substr(plain, 1, 1000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM plains), h AS (SELECT *, regexp_extract(cut, '(?s)^(.*[ \\n])', 1) AS head FROM c) SELECT doc_id, CASE WHEN length(plain) <= 1000 THEN plain WHEN length(head) - 1 > 650 THEN regexp_replace(head, '\\s+$', '') || '...' ELSE cut || '...' END AS context FROM h",
        "markdown_links": f"WITH p AS (SELECT page_id, url, {url_parts} FROM pages), k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: regexp_extract(x, '^[^=]*=(.*)$', 1) <> '' AND lower(string_split(x, '=')[1]) NOT IN ({tracking})) AS kept FROM p) SELECT page_id, 'see [page](' || head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string({together}, '&') ELSE '' END || tail || ') and [here](b?ref=1)' AS text FROM k",
        "citation_sources": "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE url END, ''), CASE WHEN page_id % 6 <> 0 THEN page_id::VARCHAR END, 'unknown') AS source FROM pages",
        "depth_trim": f"WITH {GATED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place, query_id % 5 + 1 AS depth FROM gated) SELECT query_id, chunk_id, match_source FROM r WHERE match_source = 'dense' OR depth > 2 OR place <= depth",
        "rerank_negated": f"WITH {FUSED}, q(query_id, wanted) AS (VALUES {_values((k, '[' + ', '.join(map(_text, sorted(set(r._words(t))))) + ']') for k, t in corpus.QUERIES)}), s AS (SELECT f.query_id, f.chunk_id, f.score, contains(lower(d.text), 'onble') AS hit, 8.0::DOUBLE * len(list_intersect(wanted, {_tokens('d.text')})) / greatest(len(wanted), 1) - 4 AS rr FROM fused10 f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rr, 9) DESC, chunk_id) <= 7), n AS (SELECT query_id, chunk_id, rr - CASE WHEN hit THEN 2 ELSE 0 END AS rr, score * CASE WHEN hit THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM b) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rr, 9) DESC, chunk_id)::INT AS rank, round(rr, 6) AS rerank_score, round(score, 6) AS score FROM n",
        "metric_coverage": "WITH l AS (SELECT doc_id % 2 = 0 AS even, CASE WHEN doc_id % 7 <> 0 THEN quality END AS quality, CASE WHEN toxic = 0 THEN 1 END AS toxic FROM labels) SELECT 'quality' AS metric, round((count(quality) FILTER (WHERE even))::DOUBLE / (count(*) FILTER (WHERE even)), 6) AS even, round((count(quality) FILTER (WHERE NOT even))::DOUBLE / (count(*) FILTER (WHERE NOT even)), 6) AS odd FROM l UNION ALL SELECT 'toxic', round((count(toxic) FILTER (WHERE even))::DOUBLE / (count(*) FILTER (WHERE even)), 6), round((count(toxic) FILTER (WHERE NOT even))::DOUBLE / (count(*) FILTER (WHERE NOT even)), 6) FROM l",
        "ndcg_recall_mrr": f"WITH {DENSE_ALL}, {QRELS}, {_metrics('m', 'dense10')} SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM m",
        "hit_at_k": f"WITH {DENSE_ALL}, {QRELS}, {_metrics('m', 'dense10')} SELECT k, round(avg(CASE WHEN first <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM m, (VALUES (1), (3), (5), (10)) v(k) GROUP BY k",
        "precision_recall_at5": f"WITH {DENSE_ALL}, {QRELS}, e AS (SELECT query_id, chunk_id FROM qrels WHERE rel > 1), t AS (SELECT query_id, count(*) AS n FROM e GROUP BY query_id), g AS (SELECT d.query_id, count(*) FILTER (WHERE rank <= 5) AS cut, count(e.chunk_id) FILTER (WHERE rank <= 5) AS hit, min(rank) FILTER (WHERE e.chunk_id IS NOT NULL) AS first FROM dense10 d LEFT JOIN e ON e.query_id = d.query_id AND e.chunk_id = d.chunk_id GROUP BY d.query_id) SELECT g.query_id, round(hit::DOUBLE / n, 6) AS recall_at_5, round(hit::DOUBLE / cut, 6) AS precision_at_5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM g JOIN t USING (query_id)",
        "metric_compare_pivot": f"WITH {FUSED}, {QRELS}, {_metrics('m', 'dense10')}, {_metrics('h', 'fused10')} SELECT * FROM (SELECT 'ndcg' AS metric, round((SELECT avg(ndcg) FROM m), 6) AS dense, round((SELECT avg(ndcg) FROM h), 6) AS hybrid UNION ALL SELECT 'recall', round((SELECT avg(recall) FROM m), 6), round((SELECT avg(recall) FROM h), 6) UNION ALL SELECT 'mrr', round((SELECT avg(mrr) FROM m), 6), round((SELECT avg(mrr) FROM h), 6))",
        "latency_percentiles": "SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95 FROM events GROUP BY event_type",
        "ingest_dedup": "WITH d AS (SELECT doc_id, source AS collection, sha256(text) AS h FROM documents), f AS (SELECT collection, h, min(doc_id) AS doc_id FROM d GROUP BY ALL) SELECT collection, count(*) AS n_new, min(doc_id) AS first_doc FROM f WHERE NOT (collection = 'src1' AND h IN (SELECT h FROM d WHERE collection = 'src0')) GROUP BY collection",
        "cascade_delete": "WITH k AS (SELECT * FROM documents WHERE source NOT IN ('src0', 'src3')) SELECT 'collections' AS name, count(DISTINCT source) AS n FROM k UNION ALL SELECT 'documents', count(*) FROM k UNION ALL SELECT 'links', count(*) FROM k",
        "upsert_latest": "SELECT user_id, event_type, value, event_id AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "quota_daily": "WITH RECURSIVE e AS (SELECT user_id AS tenant, ts::DATE AS day, floor(value)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events), f AS (SELECT tenant, day, k, tokens, tokens <= 200 AS ok, CASE WHEN tokens <= 200 THEN greatest(tokens, 0) ELSE 0 END AS used FROM e WHERE k = 1 UNION ALL SELECT e.tenant, e.day, e.k, e.tokens, f.used + e.tokens <= 200, f.used + CASE WHEN f.used + e.tokens <= 200 THEN greatest(e.tokens, 0) ELSE 0 END FROM f JOIN e ON e.tenant = f.tenant AND e.day = f.day AND e.k = f.k + 1) SELECT tenant, day, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE ok) AS n_admitted, count(*) AS n FROM f GROUP BY tenant, day",
        "rate_per_minute": f"SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > {c.RATE_LIMIT} AS limited FROM events GROUP BY 1, 2",
        "log_monthly": "SELECT strftime(ts, '%Y_%m') AS partition, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
        "export_delta": f"SELECT o_orderkey AS id, sha256(o_orderkey || '|' || sha256(o_orderkey::VARCHAR)) AS sync_hash FROM orders WHERE o_orderdate > TIMESTAMP '{c.WATERMARK:%Y-%m-%d}'",
        "export_rows": "SELECT doc_id::VARCHAR AS chunk_id, source, 'unknown' AS upstream_license, doc_id::VARCHAR AS document_id, 0 AS chunk_index, CASE WHEN coalesce(text, '') = '' THEN doc_id::VARCHAR ELSE sha256(text) END AS content_hash, lang AS namespace, lang || ', x' AS tags, source AS collection_name FROM documents",
        "value_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL",
        "citations": f"WITH {FUSED}, a AS (SELECT f.query_id, string_agg('[' || rank || '] ' || substr(d.text, 1, 6000), chr(10) || chr(10) ORDER BY rank) AS answer FROM fused10 f JOIN documents d ON d.doc_id = f.chunk_id GROUP BY f.query_id) SELECT query_id, sha256(answer) AS answer_sha256, regexp_matches(answer, '\\[\\d+\\]') AS cites, {' OR '.join(f'contains(lower(answer), {_text(t)})' for t in tx.ABSTENTIONS)} AS abstains FROM a",
        "explain_rows": f"WITH {GATED} SELECT query_id, count(*) AS n, max(match_source) AS mode, round(max(score), 6) AS best FROM gated GROUP BY query_id",
        "error_classes": f"SELECT conv_id, turn, {_error_case()} AS class FROM (SELECT conv_id, turn, lower(concat_ws(' ', text, ([{errors}])[turn % {len(c.ERROR_TEXTS)} + 1])) AS e FROM conversations)",
        "valid_rows": "WITH g AS (SELECT conv_id, trim(arg_max(text, turn), ' ') AS answer, list(text) AS texts, list(role) AS ids FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(length(answer) >= 30 AND len(list_filter(texts, lambda x: trim(coalesce(x, ''), ' ') <> '')) > 0 AND len(ids) > 0 AND NOT ends_with(answer, '...') AND 1 - len(list_distinct(ids))::DOUBLE / len(ids) <= 0.6, false) AS valid FROM g",
        "quality_gate": "SELECT *, CASE WHEN error_rate < 0.1 AND coverage >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS error_rate, round(avg(CASE WHEN value >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM events)",
        "json_props": "SELECT event_id, props AS json FROM events",
        "vector_literals": "SELECT vec_id, len(embedding)::INT AS dim, '[' || array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT), ',') || ']' AS literal FROM embeddings",
        "auth_lookup": "SELECT c_mktsegment AS plan, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 <> 0 GROUP BY 1",
        "cache_hit_rate": "WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, event_type, k, false AS hit, t + 3600000000 AS until FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_type, e.k, e.t < f.until, CASE WHEN e.t < f.until THEN f.until ELSE e.t + 3600000000 END FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1) SELECT event_type, count(*) FILTER (WHERE hit) AS n_hits, count(*) AS n FROM f GROUP BY event_type",
        "cache_keys": "SELECT event_id, sha256(user_id || chr(31) || event_type || chr(31) || props) AS key FROM events",
        "queue_states": f"{jobs} SELECT status, count(*) AS n FROM jobs GROUP BY status",
        "sql_dense_search": f"WITH {DENSE_ALL} {RANKED} dense10",
        "sql_neighbors": "SELECT c.conv_id, c.turn, c.role FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn = 3) a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn BETWEEN a.turn - 1 AND a.turn + 1",
        "sql_concepts": f"WITH {EDGES} SELECT e.src AS region, count(DISTINCT e.dst) AS n_concepts, count(*) AS n_links, round(avg(l.confidence), 6) AS confidence FROM (SELECT DISTINCT src, dst, relation FROM edges WHERE src LIKE 'r%') e JOIN links l ON l.concept = e.dst GROUP BY e.src",
        "sql_counts": "SELECT source AS collection, count(*) AS n, (SELECT max(len(embedding)) FROM embeddings) AS dim FROM documents WHERE source IS NOT NULL GROUP BY source",
        "office_texts": "SELECT doc_id, 0.98::DOUBLE AS confidence, sha256(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\f\\v]')), chr(10) || chr(10))) AS text_sha256 FROM documents",
        "phased_job": """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN least(event_id % 5, 2) ELSE 0 END::INT AS attempt, event_type = 'error' AND event_id % 5 > 2 AS never FROM events)
SELECT attempt, CASE WHEN never THEN 'HTTP 429: rate limit' WHEN event_id % 7 = 0 THEN 'malformed answer' END AS error, count(*) AS n, sum(event_id)::BIGINT AS ids FROM e GROUP BY 1, 2""",
        "derived_columns": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang || '-x' ELSE lang END AS lang, sha256(t) AS chunk_hash, len(string_split(t, ' '))::INT AS n_words, CASE WHEN doc_id % 7 = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS updated_at FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'new ' || text ELSE text END AS t FROM documents)",
        "allowed_scan": "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_order FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey",
        "explain_detail": f"""WITH {GATED}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS place, chunk_id, doc_id::VARCHAR AS document_id, source AS source_url, round(score, 6) AS score, match_source,
  max(match_source) OVER (PARTITION BY query_id) AS mode, count(*) OVER (PARTITION BY query_id) AS n_rows FROM gated LEFT JOIN documents ON doc_id = chunk_id""",
        "failure_summary": f"""WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'timed out' WHEN event_type = 'click' THEN 'eval_failed' WHEN user_id % 2 = 0 THEN props END AS error FROM events),
k AS (SELECT CASE WHEN error IS NOT NULL THEN {_error_case()} END AS kind FROM (SELECT error, lower(error) AS e FROM r))
SELECT count(*) AS n, count(kind) AS n_failed, count(*) FILTER (WHERE kind = 'api_timeout') AS n_timeout, count(*) FILTER (WHERE kind = 'evaluator_parse_failure') AS n_evaluator FROM k""",
        "raw_ingest": """SELECT CASE WHEN length(text) > 100000 THEN 'too long' WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'blank' WHEN doc_id % 7 = 0 AND coalesce(source, '') <> '' THEN 'collection is no UUID' ELSE 'taken' END AS outcome,
  count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY outcome""",
        "entity_mentions": f"{named} SELECT low AS entity, count(*) AS n, min(doc_id) AS first_chunk FROM said GROUP BY low",
        "chunk_concepts": f"""{named}, heads AS (
  SELECT doc_id, lower(source) AS low, CASE WHEN lang IS NULL THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, lower(lang), 1.0::DOUBLE FROM documents WHERE lang IS NOT NULL AND lower(lang) IS DISTINCT FROM lower(source)
  UNION ALL SELECT doc_id, 'corpus', 1.0::DOUBLE FROM documents WHERE source IS NULL AND lang IS NULL)
SELECT low AS concept, confidence, count(*) AS n, sum(doc_id)::BIGINT AS chunks FROM (
  SELECT * FROM heads UNION ALL SELECT doc_id, low, 0.75::DOUBLE FROM said s WHERE low <> 'corpus' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = s.doc_id AND h.low = s.low)) GROUP BY ALL""",
        "queue_outcomes": """WITH log AS (SELECT user_id AS job, event_id AS id, ts, CASE event_type WHEN 'view' THEN 'queue' WHEN 'click' THEN 'dequeue' WHEN 'error' THEN 'fail' ELSE 'complete' END AS action, props FROM events),
made AS (SELECT job, min((ts, id)) AS first FROM log WHERE action = 'queue' AND ts IS NOT NULL GROUP BY job),
r AS (SELECT job, arg_max(action, (ts, id)) FILTER (WHERE action IN ('complete', 'fail')) AS e, arg_max(props, (ts, id)) FILTER (WHERE action IN ('complete', 'fail')) AS props, count(*) FILTER (WHERE action = 'dequeue') AS taken
  FROM log JOIN made USING (job) WHERE (ts, id) > first AND action <> 'queue' GROUP BY job)
SELECT m.job, CASE WHEN e = 'complete' THEN 'complete' WHEN e = 'fail' THEN 'failed' WHEN taken > 0 THEN 'processing' ELSE 'queued' END AS status, CASE WHEN e = 'fail' THEN r.props END AS error FROM made m LEFT JOIN r USING (job)""",
        "queue_dequeue": f"{jobs} SELECT job, status, \"at\" FROM jobs WHERE status = 'queued' ORDER BY \"at\", job LIMIT 10",
        "tombstones": "WITH g AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN g USING (user_id) WHERE gone IS NULL OR event_id > gone GROUP BY e.user_id",
        "failure_report": f"SELECT class, count(*) AS n FROM (SELECT {_error_case()} AS class FROM (SELECT lower(coalesce(CASE WHEN event_type = 'error' THEN 'timed out' WHEN event_type = 'click' THEN 'HTTP ' || user_id ELSE props END, '')) AS e FROM events)) GROUP BY class",
        "slowest_samples": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5",
        "order_scan": "SELECT nullif(o_orderstatus, 'O') AS status, o_orderkey AS id FROM orders",
        "rerank_gate": f"WITH {GATED} SELECT c.query_id, (c.query_id % 5 + 1 = 5) OR (c.query_id % 5 + 1 >= 3 AND NOT EXISTS (SELECT 1 FROM gated g WHERE g.query_id = c.query_id AND match_source = 'dense' AND score >= 0.45)) AS rerank FROM centroids c",
        "hop_modes": f"SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'manual' WHEN turn % 5 + 1 <= 2 THEN 'concept_direct' ELSE 'auto' END AS mode, CASE WHEN turn % 4 = 0 THEN 2 WHEN turn % 5 + 1 <= 2 THEN 0 WHEN regexp_matches(trim(query), {_text(relational)}) THEN 1 ELSE 0 END AS hops FROM ({asked})",
        "fallback_answers": f"WITH {FUSED}, a AS (SELECT f.query_id, string_agg(trim(d.text, ' '), chr(10) || chr(10) ORDER BY rank) AS answer FROM fused10 f JOIN documents d ON d.doc_id = f.chunk_id WHERE trim(d.text, ' ') <> '' GROUP BY f.query_id) SELECT query_id, sha256(answer) AS answer_sha256, ceil(length(answer)::DOUBLE / 500)::BIGINT AS n_pieces FROM a",
        "graph_simulated": f"WITH RECURSIVE w(query_id, word) AS (VALUES {_values((k, _text(x)) for k, t in corpus.QUERIES for x in sorted(set(t.lower().split())))}), base AS (SELECT query_id, doc_id AS chunk_id, count(*) / (1 + 0.1::DOUBLE * doc_id) AS score FROM documents, w WHERE contains(lower(text), word) GROUP BY query_id, doc_id), {_top('starts', 'base', 5)}, {EDGES}, seeds AS (SELECT DISTINCT s.query_id, l.concept FROM starts s JOIN links l USING (chunk_id)), {_walk('edges', 'seeds', 1)}, parts AS (SELECT query_id, chunk_id, score FROM base UNION ALL SELECT query_id, chunk_id, confidence * 0.35::DOUBLE / (1.0 + depth) FROM reached JOIN links USING (concept)), total AS (SELECT query_id, chunk_id, sum(score) AS score FROM parts GROUP BY ALL), {_top('best', 'total', r.RESULTS)} {RANKED} best",
        "graph_second_ring": f"WITH RECURSIVE {EDGES}, roots AS (SELECT 0 AS query_id, 'r' || r_regionkey AS concept FROM region), {_walk('edges', 'roots', 2)} SELECT substr(concept, 1, 1) AS kind, count(*) AS n FROM reached WHERE depth = 2 GROUP BY 1",
        "benchmark_questions": "WITH t AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation) SELECT i AS id, replace(['What is {topic}?', 'How does {topic} relate to trade?', 'How to ship to {topic}'][i % 3 + 1], '{topic}', n_name) AS query, ['fact', 'relation', 'procedure'][i % 3 + 1] AS kind FROM range(120) g(i) JOIN t ON t.k = (i // 3) % 25",
        "grounding": f"WITH {DENSE_ALL}, {QRELS} SELECT d.query_id, round(count(q.chunk_id) / 5.0::DOUBLE, 6) AS grounded FROM dense10 d LEFT JOIN qrels q ON q.query_id = d.query_id AND q.chunk_id = d.chunk_id WHERE rank <= 5 GROUP BY d.query_id",
        "index_percentiles": "SELECT event_type, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95::DOUBLE)::BIGINT) + 1] AS p95 FROM events GROUP BY event_type",
        "document_counts": "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1",
        "chunk_paragraphs": f"WITH {MARKDOWN}, p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM marked) SELECT doc_id, count(*) AS n, sum(length(part))::BIGINT AS chars FROM p WHERE trim(part, ' ') <> '' GROUP BY doc_id",
        "filtered_export": f"SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS watermark FROM orders WHERE o_orderdate > TIMESTAMP '{c.WATERMARK:%Y-%m-%d}' AND o_orderstatus = 'F' AND starts_with(o_orderpriority, '1') GROUP BY 1",
        "ext_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "ext_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start",
        "ext_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    }
