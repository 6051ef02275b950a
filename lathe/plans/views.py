"""Derived views: a code graph, patches, findings, metrics and events, made from the star schema and the documents."""

from __future__ import annotations

from .dialect import Dialect, view


@view("kg_files")
def kg_files(d: Dialect) -> str:
    return f"""
SELECT '.' AS path, 'dir' AS kind, CAST(NULL AS STRING) AS parent
UNION ALL SELECT r_name, 'dir', '.' FROM {d.t('region')}
UNION ALL SELECT r_name || '/' || n_name, 'dir', r_name FROM {d.t('nation')} JOIN {d.t('region')} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name || '.py', 'file', r_name || '/' || n_name
  FROM {d.t('customer')} JOIN {d.t('nation')} ON c_nationkey = n_nationkey JOIN {d.t('region')} ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 'lib/' || p_brand || '.py', 'file', 'lib' FROM {d.t('part')}
UNION ALL SELECT 'lib', 'dir', '.'"""


@view("order_paths")
def order_paths(d: Dialect) -> str:
    return f"""
SELECT o_orderkey, r_name || '/' || n_name || '/' || c_name || '.py' AS path, o_orderpriority, o_orderstatus, o_orderdate
FROM {d.t('orders')} JOIN {d.t('customer')} ON o_custkey = c_custkey JOIN {d.t('nation')} ON c_nationkey = n_nationkey JOIN {d.t('region')} ON n_regionkey = r_regionkey"""


@view("kg_symbols", "order_paths")
def kg_symbols(d: Dialect) -> str:
    return f"""
SELECT 'o' || CAST(o_orderkey AS STRING) AS node_id, path, 'order_' || CAST(o_orderkey % 20 AS STRING) AS name, CAST(NULL AS STRING) AS qualified_name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'class' WHEN '2' THEN 'function' WHEN '3' THEN 'method' WHEN '4' THEN 'interface' ELSE 'enum' END AS kind,
  o_orderkey % 400 + 1 AS start_line, o_orderkey % 400 + 1 + o_orderkey % 37 AS end_line, {d.sha256("o_orderpriority || o_orderstatus")} AS fingerprint
FROM order_paths
UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'lib/' || p_brand || '.py', p_name, p_brand || '.' || p_name, 'function', p_partkey % 300 + 1, p_partkey % 300 + 6, {d.sha256("p_type")} FROM {d.t('part')}"""


@view("kg_edges", "order_paths")
def kg_edges(d: Dialect) -> str:
    return f"""
SELECT path AS src, 'o' || CAST(o_orderkey AS STRING) AS dst, 'HAS_SYMBOL' AS edge_type FROM order_paths
UNION ALL SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING), 'p' || CAST(l_partkey AS STRING), 'CALLS' FROM {d.t('lineitem')}
UNION ALL SELECT DISTINCT o.path, 'lib/' || p_brand || '.py', 'IMPORTS' FROM {d.t('lineitem')} JOIN order_paths o ON l_orderkey = o_orderkey JOIN {d.t('part')} ON l_partkey = p_partkey"""


@view("kg_texts")
def kg_texts(d: Dialect) -> str:
    return f"""
SELECT 't' || CAST(doc_id AS STRING) AS node_id, CASE WHEN doc_id % 3 = 0 THEN 'docs/' WHEN doc_id % 3 = 1 THEN 'README/' ELSE '' END || source || '/' || coalesce(lang, 'xx') || '/' || CAST(doc_id AS STRING) || '.md' AS path,
  doc_id % 50 + 1 AS start_line, n_chars FROM {d.t('documents')}"""


@view("seeds", "kg_symbols")
def seeds(d: Dialect) -> str:
    return "SELECT CAST(substr(node_id, 2) AS BIGINT) AS seed_id, node_id, path, name, kind, fingerprint, start_line, end_line FROM kg_symbols WHERE node_id LIKE 'o%' AND CAST(substr(node_id, 2) AS BIGINT) % 97 = 0"


@view("changed_lines", "order_paths")
def changed_lines(d: Dialect) -> str:
    return f"SELECT DISTINCT path, (l_partkey * 7) % 440 + 1 AS line, 'h' || CAST(l_suppkey % 5 AS STRING) AS hunk_id FROM {d.t('lineitem')} JOIN order_paths ON l_orderkey = o_orderkey"


@view("doc_lines")
def doc_lines(d: Dialect) -> str:
    lines = d.split("text", "\n") if d.spark else "string_split(text, chr(10))"
    return d.rows_of(f"(SELECT doc_id, source, {lines} AS _lines FROM {d.t('documents')} WHERE text IS NOT NULL) _d", "_lines", "doc_id, source", "content", "n")


@view("patch_lines", "doc_lines")
def patch_lines(d: Dialect) -> str:
    """Every document as a patch: hunks of 20 lines, marked ' ', '+' or '-' by (doc_id + line) mod 3."""
    return """
SELECT doc_id, source || '/' || CAST(doc_id AS STRING) || '.py' AS path, CAST(floor((n - 1) / 20) AS BIGINT) AS hunk, CAST((n - 1) % 20 AS BIGINT) AS idx,
  CASE (doc_id + n) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END AS mark, content FROM doc_lines"""


@view("hunks", "patch_lines")
def hunks(d: Dialect) -> str:
    return """
SELECT doc_id, path, hunk, hunk * 20 + 1 AS old_start, hunk * 20 + 1 AS new_start, count(*) AS n_lines,
  sum(CASE WHEN mark <> '+' THEN 1 ELSE 0 END) AS old_count, sum(CASE WHEN mark <> '-' THEN 1 ELSE 0 END) AS new_count,
  sum(CASE WHEN mark = '+' THEN 1 ELSE 0 END) AS additions, sum(CASE WHEN mark = '-' THEN 1 ELSE 0 END) AS deletions
FROM patch_lines GROUP BY doc_id, path, hunk"""


@view("findings")
def findings(d: Dialect) -> str:
    return f"""
SELECT d.doc_id AS ord, CASE d.doc_id % 5 WHEN 0 THEN 'blocker' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'nit' END AS severity,
  CASE d.doc_id % 8 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'performance' WHEN 3 THEN 'style' WHEN 4 THEN 'design' WHEN 5 THEN 'docs' WHEN 6 THEN 'observability' ELSE 'maintainability' END AS category,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (n_chars % 100) / 100.0E0 END AS confidence, substr(text, 1, 60) AS title, text AS message, source || '.md' AS file_path,
  coalesce(quality, 0) = 1 AS anchored FROM {d.t('documents')} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {d.t('labels')} GROUP BY doc_id) l ON l.doc_id = d.doc_id"""


@view("query_metrics")
def query_metrics(d: Dialect) -> str:
    return f"SELECT event_id, ts, event_type AS query_type, value AS ms, event_type = 'error' AS failed, CAST({d.json('props', 'k')} AS BIGINT) % 2 = 0 AS cache_hit, user_id FROM {d.t('events')}"


@view("workflow_events")
def workflow_events(d: Dialect) -> str:
    return f"""
SELECT 'wf-' || CAST(user_id AS STRING) AS workflow_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'workflow_completed' WHEN 'error' THEN 'activity_failed' WHEN 'signup' THEN 'workflow_started' WHEN 'click' THEN 'activity_started' ELSE 'activity_completed' END AS event_type
FROM {d.t('events')}"""


@view("candidates", "kg_symbols")
def candidates(d: Dialect) -> str:
    """Called parts of every order, with how often it calls them and a document as their code, whose length is told where documents are stored."""
    return f"""
SELECT e.src, e.pack, e.dst AS item_id, 'CALLS' AS relationship_type, e.calls, s.path AS file_path, s.name AS symbol_name, s.kind AS symbol_type, s.start_line, s.end_line,
  CAST(substr(e.dst, 2) AS BIGINT) % 5 + 1 AS priority, (CAST(substr(e.dst, 2) AS BIGINT) * 37 % 100) / 100.0E0 AS strength, CAST(substr(e.dst, 2) AS BIGINT) % 7 = 0 AS is_seed,
  t.doc_id AS code_id, t.chars, t.text AS code_snippet FROM (SELECT 'o' || CAST(l_orderkey AS STRING) AS src, l_orderkey AS pack, 'p' || CAST(l_partkey AS STRING) AS dst, count(*) AS calls FROM {d.t('lineitem')} GROUP BY l_orderkey, l_partkey) e
JOIN kg_symbols s ON s.node_id = e.dst CROSS JOIN (SELECT count(*) AS docs FROM {d.t('documents')}) n JOIN (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS chars FROM {d.t('documents')}) t ON t.doc_id = CAST(substr(e.dst, 2) AS BIGINT) % n.docs"""


@view("call_sites", "kg_edges", "kg_symbols")
def call_sites(d: Dialect) -> str:
    """Calls of parts in the files of orders: by the part's module, by its own name, or by a name that isn't imported."""
    return """
SELECT CAST(substr(e.src, 2) AS BIGINT) * 100000 + CAST(substr(e.dst, 2) AS BIGINT) AS call_id, o.path, o.start_line + CAST(substr(e.dst, 2) AS BIGINT) % 5 AS line, p.name AS callee,
  CASE WHEN p.start_line % 3 = 0 THEN 'm_' || substr(p.path, 5, length(p.path) - 7) WHEN p.start_line % 7 = 0 THEN 'unknown' END AS receiver, p.path AS target
FROM kg_edges e JOIN kg_symbols o ON o.node_id = e.src JOIN kg_symbols p ON p.node_id = e.dst WHERE e.edge_type = 'CALLS'"""


@view("import_map", "call_sites")
def import_map(d: Dialect) -> str:
    """What files import: modules under an alias, and names of parts."""
    return "SELECT DISTINCT path, 'm_' || substr(target, 5, length(target) - 7) AS local, target, CAST(NULL AS STRING) AS original FROM call_sites UNION SELECT DISTINCT path, callee, min(target), callee FROM call_sites WHERE receiver IS NULL GROUP BY path, callee"


@view("llm_reviews")
def llm_reviews(d: Dialect) -> str:
    """Assistant turns as whole reviews of two findings, with other names for some fields."""
    one = "'{\"title\": \"Finding ' || CAST(turn AS STRING) || '\", \"description\": \"A description of it\", \"severity\": \"' || CASE turn % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'warning' ELSE 'odd' END || '\", \"category\": \"vulnerability\", \"confidence\": ' || CAST(conv_id % 30 / 10.0E0 AS STRING) || ', \"line\": ' || CAST(conv_id % 50 AS STRING) || ', \"code_examples\": [\"a\", \"b\", \"c\", \"d\"]}'"
    two = "'{\"message\": \"Short\", \"file_path\": \"a.py\", \"line_in_hunk\": 0, \"line\": 7}'"
    return f"SELECT conv_id, turn, '{{\"findings\": [' || {one} || ', ' || {two} || '], \"summary\": \"ok\"}}' AS raw FROM {d.t('conversations')} WHERE role = 'assistant'"


@view("llm_responses")
def llm_responses(d: Dialect) -> str:
    """Assistant turns as answers: plain, fenced, with a trailing comma, and broken JSON."""
    body = "'{\"severity\": \"' || CASE turn % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'suggestion' ELSE 'odd' END || '\", \"category\": \"' || CASE conv_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'formatting' ELSE 'odd' END || '\", \"confidence\": ' || CAST((conv_id * 7 + turn) % 30 / 10.0E0 AS STRING)"
    nl = "'\\n'" if d.spark else "chr(10)"
    return f"""
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN {body} || '}}' WHEN 1 THEN 'Here:' || {nl} || '```json' || {nl} || {body} || '}}' || {nl} || '```' WHEN 2 THEN {body} || ',}}' ELSE 'no json: ' || {body} END AS raw
FROM {d.t('conversations')} WHERE role = 'assistant'"""
