"""DuckDB SQL for the program-graph queries, written on the raw tables."""

from __future__ import annotations

_EDGES = """
edges AS (
  SELECT l_orderkey * 8 + l_linenumber AS ord, '<tpch.n' || s_nationkey || '.S' || l_suppkey || ': void run()>' AS caller,
         '<tpch.' || lower(p_type) || '.P' || (p_partkey % 100) || ': void call(int)>' AS callee, p_type, p_partkey, l_suppkey, s_nationkey,
         CASE l_returnflag WHEN 'A' THEN 'soot_cg' WHEN 'N' THEN 'jimple_invoke' ELSE 'threading_synthetic' END AS edge_source,
         CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS confidence,
         CASE WHEN l_suppkey % 10 = 0 THEN 'framework' WHEN s_nationkey % 7 = 0 THEN 'library' WHEN s_nationkey > 20 THEN 'not_app' ELSE 'kept' END AS reason
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
_CATALOG = "catalog(kind, category_id, priority, weight, prank) AS (VALUES ('PROMO', 'CAT_PROMO', 'CRITICAL', CAST(0.9 AS DOUBLE), 1), ('ECONOMY', 'CAT_ECONOMY', 'HIGH', CAST(0.6 AS DOUBLE), 2), ('STANDARD', 'CAT_STANDARD', 'MEDIUM', CAST(0.4 AS DOUBLE), 3), ('LARGE', 'CAT_LARGE', 'LOW', CAST(0.2 AS DOUBLE), 4))"
_HITS = f"{_EDGES}, {_CATALOG}, hits AS (SELECT caller, callee, category_id, priority, weight, prank, l_suppkey, s_nationkey, CAST(0.05 AS DOUBLE) * (l_suppkey % 11) AS investigability, min(ord) AS ord FROM edges JOIN catalog ON kind = p_type WHERE reason = 'kept' GROUP BY caller, callee, category_id, priority, weight, prank, l_suppkey, s_nationkey)"
_GROUPS = f"{_HITS}, groups AS (SELECT caller, s_nationkey, l_suppkey, count(*) AS n_hits, string_agg(DISTINCT category_id, '|' ORDER BY category_id) AS categories, min(prank) AS prank, count(*) FILTER (priority = 'CRITICAL') AS n_critical, count(*) FILTER (priority = 'HIGH') AS n_high, count(*) FILTER (priority = 'MEDIUM') AS n_medium, count(*) FILTER (priority = 'LOW') AS n_low, round(avg(investigability), 6) AS investigability, max(weight) AS weight, min(ord) AS ord FROM hits GROUP BY ALL)"
_GROUPS = _GROUPS.replace("GROUP BY ALL", "GROUP BY caller, s_nationkey, l_suppkey")
_NAME = "CASE prank WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END"
_DAYS = "days AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list_sort(list(DISTINCT event_type)) AS c FROM events GROUP BY ALL)"
_DAYS = _DAYS.replace("GROUP BY ALL", "GROUP BY user_id, CAST(ts AS DATE)")


def _flags(source: str) -> str:
    return f"""flags AS (SELECT *, list_has_all(c, ['click', 'purchase']) AS p0, list_contains(c, 'error') AND list_has_any(c, ['signup', 'view']) AS p1,
      list_contains(c, 'view') AND list_has_any(c, ['click', 'signup']) AND list_has_any(c, ['purchase', 'error']) AS p2,
      len(list_intersect(c, ['click', 'view', 'signup', 'error'])) >= 3 AS p3 FROM {source})"""


_PURCHASE = """
a AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
g AS (SELECT caller, callee, min(w) AS w FROM (
  SELECT 'c' || o_custkey AS caller, 'p' || l_partkey AS callee, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS w FROM a
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END FROM a
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier) GROUP BY caller, callee),
roots AS (SELECT 'c' || c_custkey AS method FROM customer)"""
#: Distances in the layers customer, part, supplier, nation: least over the layer before, and its first settled method.
_DIST = f"""{_PURCHASE},
d0 AS (SELECT method, CAST(0 AS BIGINT) AS dist, CAST(NULL AS VARCHAR) AS pred, method AS path FROM roots),
d1 AS (SELECT callee AS method, min(dist + w) AS dist, arg_min(method, (dist + w, dist, method)) AS pred, arg_min(path, (dist + w, dist, method)) AS path FROM d0 JOIN g ON caller = method GROUP BY callee),
d2 AS (SELECT callee AS method, min(dist + w) AS dist, arg_min(method, (dist + w, dist, method)) AS pred, arg_min(path || '>' || method, (dist + w, dist, method)) AS path FROM d1 JOIN g ON caller = method GROUP BY callee),
d3 AS (SELECT callee AS method, min(dist + w) AS dist, arg_min(method, (dist + w, dist, method)) AS pred, arg_min(path || '>' || method, (dist + w, dist, method)) AS path FROM d2 JOIN g ON caller = method GROUP BY callee),
d AS (SELECT method, dist, pred, path, 0 AS hops FROM d0 UNION ALL SELECT method, dist, pred, path || '>' || method, 1 FROM d1 UNION ALL SELECT method, dist, pred, path || '>' || method, 2 FROM d2 UNION ALL SELECT method, dist, pred, path || '>' || method, 3 FROM d3)"""
_TREE = "tree AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
_BOOSTS = "CASE WHEN p0 THEN {0} ELSE 0 END + CASE WHEN p1 THEN {1} ELSE 0 END + CASE WHEN p2 THEN {2} ELSE 0 END + CASE WHEN p3 THEN {3} ELSE 0 END + {4}"


def _score(*boosts: float) -> str:
    b = _BOOSTS.format(*boosts)
    return f"""WITH {_DAYS}, {_flags('days')}
SELECT user_id, day, round(CAST(0.4 + {b} AS DOUBLE), 6) AS raw_score, round(CAST(least(0.4 + {b}, 1.0) AS DOUBLE), 6) AS threat_score,
       CASE WHEN p2 THEN 'CRITICAL' WHEN p0 THEN 'HIGH' WHEN len(c) > 3 THEN 'MEDIUM' ELSE 'LOW' END AS effective_priority FROM flags"""


def _catalog_scores() -> str:
    """Boosts and overrides of the catalog, clause by clause, over one list column."""
    from ..operators.rules import CATALOG

    names = sorted({c for p in CATALOG for k in (4, 5, 6, 8) for c in p[k]})
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    tests = []
    for p in CATALOG:
        parts = [f"list_has_all(c, {quoted(p[4])})"] if p[4] else []
        parts += [f"list_has_any(c, {quoted(x)})" for x in (p[5], p[6]) if x]
        parts += [f"len(list_intersect(c, {quoted(p[8])})) >= {p[7]}"] if p[7] else []
        tests.append((" AND ".join(parts), p[3], p[9]))
    count = " + ".join(f"CAST({t} AS INT)" for t, _, _ in tests)
    boost = " + ".join(f"CASE WHEN {t} THEN {b} ELSE 0 END" for t, b, _ in tests)
    some = lambda level: " OR ".join(f"({t})" for t, _, o in tests if o == level)
    return f"""WITH s AS (SELECT c_custkey, list_filter(list_transform(range(0, {len(names)}), lambda i: CASE WHEN (c_custkey * 7 + i * 13) % 5 < 2 THEN {quoted(names)}[i + 1] END), lambda x: x IS NOT NULL) AS c FROM customer)
SELECT c_custkey, CAST({count} AS BIGINT) AS n_patterns, round(CAST(0.3 + {boost} AS DOUBLE), 6) AS raw_score, CASE WHEN {some("CRITICAL")} THEN 'CRITICAL' WHEN {some("HIGH")} THEN 'HIGH' ELSE 'LOW' END AS effective_priority FROM s"""


_TOK = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_.$]+')), lambda x: length(x) > 2)"

SQL = {
    "hits_by_category": f"WITH {_HITS} SELECT category_id, count(*) AS n_hits, arg_min(priority, prank) AS priority, max(weight) AS weight FROM hits GROUP BY category_id",
    "hits_ranked_topk": f"WITH {_HITS} SELECT caller, callee, priority, row_number() OVER (ORDER BY prank, investigability DESC, weight DESC, ord, caller, callee) AS rank FROM hits QUALIFY rank <= 50",
    "hits_hierarchy_match": f"WITH {_EDGES} SELECT 'CAT_PROMO' AS category_id, callee, count(*) AS n, count(DISTINCT caller) AS n_callers FROM edges WHERE p_type = 'SMALL' GROUP BY callee",
    "filter_reason_counts": f"WITH {_EDGES} SELECT reason, count(*) AS n FROM edges GROUP BY reason",
    "best_edge_per_pair": f"""WITH {_EDGES}, w AS (SELECT *, CASE edge_source WHEN 'threading_synthetic' THEN CASE WHEN confidence = 'high' THEN 3 ELSE 5 END WHEN 'soot_cg' THEN 1 ELSE 2 END AS weight FROM edges)
SELECT caller, callee, CAST(min(weight) AS BIGINT) AS weight, arg_min(edge_source, weight) AS edge_source FROM w GROUP BY caller, callee""",
    "group_rollup": f"WITH {_GROUPS} SELECT caller, n_hits, categories, {_NAME} AS priority, n_critical, n_high, n_medium, n_low, investigability, weight, 'grp-' || sha1(caller) AS group_id FROM groups",
    "block_rollup": f"""WITH {_HITS}, b AS (SELECT s_nationkey, count(DISTINCT caller) AS n_groups, CAST(count(*) AS BIGINT) AS n_hits, string_agg(DISTINCT category_id, '|' ORDER BY category_id) AS categories, min(prank) AS prank, max(weight) AS weight FROM hits GROUP BY s_nationkey)
SELECT 'tpch.n' || s_nationkey AS outer, n_groups, n_hits, categories, {_NAME} AS priority, weight, 'block-' || substr(sha1('tpch.n' || s_nationkey), 1, 12) AS block_id FROM b""",
    "pattern_match_user_day": f"""WITH {_DAYS}, {_flags('days')} SELECT user_id, day, array_to_string(c, '|') AS categories,
  array_to_string(list_filter([CASE WHEN p0 THEN 'P_ALL' END, CASE WHEN p1 THEN 'P_ANY' END, CASE WHEN p2 THEN 'P_TWICE' END, CASE WHEN p3 THEN 'P_COUNT' END, 'P_EMPTY'], lambda x: x IS NOT NULL), '|') AS patterns FROM flags""",
    "pattern_evidence_user_day": f"""WITH {_DAYS}, {_flags('days')},
e AS (SELECT user_id, day, 'P_ALL' AS pattern_id, 'click|purchase' AS evidence FROM flags WHERE p0
 UNION ALL SELECT user_id, day, 'P_ANY', 'error|' || CASE WHEN list_contains(c, 'signup') THEN 'signup' ELSE 'view' END FROM flags WHERE p1
 UNION ALL SELECT user_id, day, 'P_TWICE', 'view|' || CASE WHEN list_contains(c, 'click') THEN 'click' ELSE 'signup' END || '|' || CASE WHEN list_contains(c, 'error') THEN 'error' ELSE 'purchase' END FROM flags WHERE p2
 UNION ALL SELECT user_id, day, 'P_COUNT', array_to_string(list_sort(list_intersect(c, ['click', 'view', 'signup', 'error']))[1:3], '|') FROM flags WHERE p3)
SELECT * FROM e""",
    "threat_score_group": _score(0.20, 0.15, 0.25, 0.10, 0.01),
    "threat_score_block": _score(0.08, 0.06, 0.1, 0.04, 0.004),
    "pattern_counts_by_level": f"""WITH {_DAYS}, u AS (SELECT 'day' AS level, c FROM days UNION ALL SELECT 'user', list(DISTINCT event_type) FROM events GROUP BY user_id), {_flags('u')}
SELECT level, p AS pattern_id, count(*) AS n FROM (SELECT level, unnest([CASE WHEN p0 THEN 'P_ALL' END, CASE WHEN p1 THEN 'P_ANY' END, CASE WHEN p2 THEN 'P_TWICE' END, CASE WHEN p3 THEN 'P_COUNT' END, 'P_EMPTY']) AS p FROM flags) WHERE p IS NOT NULL GROUP BY level, p""",
    "package_union": f"WITH {_HITS} SELECT 'tpch.n' || s_nationkey AS package, count(DISTINCT caller) AS n_groups, string_agg(DISTINCT category_id, '|' ORDER BY category_id) AS categories FROM hits GROUP BY s_nationkey",
    "package_inventory": """WITH k AS (SELECT s_nationkey AS k, 1 AS s, 0 AS c, 0 AS l, 0 AS n FROM supplier UNION ALL SELECT c_nationkey, 0, 1, 0, 0 FROM customer UNION ALL SELECT s_nationkey, 0, 0, 1, 0 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT n_nationkey, 0, 0, 0, 1 FROM nation)
SELECT 'n' || k AS package, CAST(sum(s) AS BIGINT) AS suppliers, CAST(sum(c) AS BIGINT) AS customers, CAST(sum(l) AS BIGINT) AS calls, CAST(sum(n) AS BIGINT) AS nations FROM k GROUP BY k""",
    "dominant_prefix": "SELECT substr(p_brand, 1, 7) AS prefix, count(*) AS n FROM part GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1",
    "stratified_preview": """WITH o AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM orders)
SELECT o_orderkey, priority, row_number() OVER (PARTITION BY priority ORDER BY o_orderkey) AS stratum_rank FROM o QUALIFY stratum_rank <= CASE priority WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 10 END""",
    "bfs_levels": f"WITH {_DIST} SELECT method, CAST(min(hops) AS BIGINT) AS level FROM d GROUP BY method",
    "weighted_distance": f"WITH {_DIST} SELECT method, CAST(dist AS BIGINT) AS dist, pred FROM d",
    "weighted_paths": f"WITH {_DIST} SELECT method, CAST(dist AS BIGINT) AS dist, CAST(hops AS BIGINT) AS hops, path FROM d",
    "k_hop_callers_callees": f"""WITH {_PURCHASE}, s AS (SELECT 'p' || p_partkey AS start FROM part WHERE p_partkey % 100 = 0),
h1 AS (SELECT DISTINCT start, caller AS method, 'caller' AS direction FROM s JOIN g ON callee = start UNION SELECT start, callee, 'callee' FROM s JOIN g ON caller = start),
h2 AS (SELECT DISTINCT start, caller AS method, 'caller' AS direction FROM h1 JOIN g ON callee = method UNION SELECT start, callee, 'callee' FROM h1 JOIN g ON caller = method),
n2 AS (SELECT * FROM h2 EXCEPT SELECT * FROM h1)
SELECT start, direction, CAST(hop AS BIGINT) AS hop, count(*) AS n FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM n2) GROUP BY start, direction, hop""",
    "transitive_supertypes": f"WITH RECURSIVE {_TREE}, up AS (SELECT child, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM tree UNION ALL SELECT up.child, tree.parent, depth + 1 FROM up JOIN tree ON tree.child = ancestor) SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor",
    "ancestor_component": f"""WITH RECURSIVE {_TREE}, marked AS (SELECT 'n' || n_nationkey AS m, n_name AS component FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
up AS (SELECT child AS method, child AS cur, CAST(0 AS BIGINT) AS depth FROM tree UNION ALL SELECT method, parent, depth + 1 FROM up JOIN tree ON child = cur)
SELECT method, arg_min(component, depth) AS component, min(depth) AS depth FROM up JOIN marked ON m = cur GROUP BY method""",
    "backward_slice_orders": """WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k FROM lineitem),
s AS (SELECT o, k FROM u WHERE k = 4 UNION ALL SELECT u.o, u.k FROM s JOIN u ON u.o = s.o AND u.k = s.k - 1)
SELECT 'seed' || o AS seed_id, CAST(k AS VARCHAR) AS unit_id FROM s""",
    "asof_version": "WITH v AS (SELECT DISTINCT p_size AS version FROM part WHERE p_size % 7 = 0) SELECT p_partkey AS id, p_size AS target, coalesce((SELECT min(version) FROM v WHERE version >= p_size), (SELECT max(version) FROM v)) AS version FROM part",
    "last_def_before_use": "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_value FROM events",
    "missing_bridges": "SELECT DISTINCT user_id AS caller, CAST(CAST(ts AS DATE) AS VARCHAR) AS callsite FROM events s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = s.user_id AND CAST(p.ts AS DATE) = CAST(s.ts AS DATE))",
    "coverage_gap": "SELECT c_custkey AS group_id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 450000)",
    "best_case_per_hit": "SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1",
    "merged_call_sites": """WITH m AS (SELECT o_custkey % 50 AS case_id, CAST(o_custkey AS VARCHAR) AS caller, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS primary_seed, count(DISTINCT o_orderkey) AS n_seeds, count(DISTINCT o_orderstatus) AS k, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS categories FROM orders GROUP BY 1, 2)
SELECT case_id, caller, primary_seed, n_seeds, categories, CASE WHEN k = 1 THEN categories ELSE 'MERGED(' || k || ')' END AS category FROM m""",
    "ioc_ipv4": r"""WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS ip FROM documents)
SELECT doc_id, ip, CAST(split_part(ip, '.', 1) AS INT) = 0 OR CAST(split_part(ip, '.', 1) AS INT) > 223 AS version_like FROM x""",
    "ioc_base64": r"""WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS value FROM documents) SELECT doc_id, value FROM x WHERE regexp_full_match(value, '[A-Za-z0-9+/]{20,}={0,2}')""",
    "url_domains": "SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "indicator_boundary": r"""WITH i(indicator, pattern) AS (VALUES ('tionsh.example.net', 'tionsh\.example\.net'), ('utm_source', 'utm_source'), ('page', 'page'), ('fr', 'fr'))
SELECT page_id, indicator FROM pages, i WHERE regexp_matches(lower(url), '(^|[^a-z0-9.\-])' || pattern || '($|[^a-z0-9.\-])')""",
    "keyword_evidence_map": """SELECT doc_id AS evidence_id, t AS technique_id FROM documents JOIN (VALUES ('en', 'T1001'), ('fr', 'T1002'), ('fr', 'T1003')) r(l, t) ON lang = l
UNION SELECT doc_id, t FROM documents, (VALUES ('token', 'T2001'), ('idiot', 'T2002'), ('@mail', 'T2003')) r(k, t) WHERE contains(lower(text), k)""",
    "token_overlap": f"""WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents)
SELECT c.doc_id AS claim_id, CAST(len(c.t) AS BIGINT) AS n_tokens, CAST(len(list_intersect(c.t, s.t)) AS BIGINT) AS n_found, round(CASE WHEN len(c.t) > 0 THEN len(list_intersect(c.t, s.t)) / len(c.t) ELSE 0 END, 6) AS ratio FROM d c JOIN d s ON s.doc_id + 1 = c.doc_id""",
    "source_search_first_line": r"SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda l: contains(l, 'token = '))[1] AS line FROM documents WHERE contains(text, 'token = ') ORDER BY doc_id LIMIT 20",
    "statement_kinds": "SELECT CASE turn % 4 WHEN 0 THEN 'if' WHEN 1 THEN 'return' WHEN 2 THEN 'goto' ELSE 'assign' END AS kind, turn % 4 = 0 AS branch, count(*) AS n FROM conversations GROUP BY 1, 2",
    "signature_parts": """WITH s AS (SELECT s_suppkey, 'tpch.n' || s_nationkey AS package, 'tpch.n' || s_nationkey || '.S$' || s_suppkey AS class FROM supplier)
SELECT s_suppkey, '<' || class || ': void run(int,long[],java.lang.String)>' AS signature, class, package || '.S' AS outer, package, 'run' AS method, 'void' AS ret, 'int,long[],java.lang.String' AS params, 'seed-' || substr(sha1('<' || class || ': void run(int,long[],java.lang.String)>'), 1, 12) AS seed_id FROM s""",
    "component_extras_rollup": """WITH e AS (SELECT event_type AS component, 'x' || (user_id % 7) AS extra, CAST(json_extract(props, '$.k') AS INT) AS k, value FROM events)
SELECT component, extra, CASE WHEN count(DISTINCT k % 2) > 1 THEN 'mixed' WHEN max(k % 2) = 0 THEN 'int' ELSE 'string' END AS type, bool_or(value > 60) AS required, string_agg(DISTINCT 'h' || (k % 3), '|' ORDER BY 'h' || (k % 3)) AS hints FROM e GROUP BY component, extra""",
    "capped_buckets": "WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) SELECT conv_id, role, first_turn, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS n FROM f QUALIFY n <= 2",
    "confidence_formula": """WITH g AS (SELECT doc_id % 20 AS seed, avg(quality) AS q, avg(toxic) AS x, count(*) AS n FROM labels GROUP BY 1)
SELECT seed, round(CAST(0.3 AS DOUBLE) * q + CAST(0.4 AS DOUBLE) * x + CAST(0.3 AS DOUBLE) * (n / 1000), 2) AS raw, CASE WHEN x > 0.5 OR 1 - q > 0.5 THEN 'failed' WHEN x > 0 OR 1 - q > 0.2 THEN 'partial' ELSE 'ok' END AS status FROM g""",
    "reflection_verdicts": """WITH h AS (SELECT o_orderkey, o_custkey % 1000 AS caller, o_orderpriority = '1-URGENT' AS r, o_orderpriority = '2-HIGH' AS c, o_totalprice > 400000 AS s FROM orders),
f AS (SELECT caller, count(*) FILTER (r) AS n, bool_or(c) AS c FROM h GROUP BY caller)
SELECT o_orderkey AS hit_id, CASE WHEN s THEN 'sensitive_target' WHEN n > 1 THEN 'obfuscated_chain' WHEN f.c THEN 'crypto_chain' END AS verdict FROM h JOIN f USING (caller) WHERE r""",
    "missing_support": """SELECT o_orderkey AS seed_id, string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS missing FROM orders, (VALUES (1), (3), (5), (7)) w(k)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k) GROUP BY o_orderkey""",
    "stage_durations": "SELECT user_id, event_type AS stage, round((epoch_us(max(ts) FILTER (event_id % 2 = 1)) - epoch_us(min(ts) FILTER (event_id % 2 = 0))) / 1e6, 3) AS seconds FROM events GROUP BY user_id, event_type",
    "run_summary": "SELECT user_id, arg_min(event_type, event_id) AS first_event, arg_max(event_type, event_id) AS last_event, count(*) AS n_events FROM events GROUP BY user_id",
    "event_levels": "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY 1",
    "edge_union_dedup": f"WITH {_EDGES}, b AS (SELECT caller, callee, min(CASE edge_source WHEN 'soot_cg' THEN 0 WHEN 'jimple_invoke' THEN 1 ELSE 2 END) AS k FROM edges GROUP BY caller, callee, ord % 3) SELECT CASE k WHEN 0 THEN 'soot_cg' WHEN 1 THEN 'jimple_invoke' ELSE 'threading_synthetic' END AS edge_source, count(*) AS n FROM b GROUP BY 1",
    "library_filter": """WITH n AS (SELECT ['androidx.', 'okhttp3.', 'com.example.', 'org.jsonx.', 'com.google.gson.'][p_size % 5 + 1] AS p FROM part)
SELECT p IN ('androidx.', 'okhttp3.', 'com.google.gson.') AS library, p = 'androidx.' AS framework, count(*) AS n FROM n GROUP BY 1, 2""",
    "declared_entrypoints": """WITH m AS (SELECT DISTINCT s_nationkey AS k, ['onCreate', 'onReceive', 'query', 'onBind', 'helper'][s_suppkey % 5 + 1] AS s FROM supplier WHERE s_nationkey < 20)
SELECT '<app.N' || k || ': void ' || s || '()>' AS method FROM m WHERE CASE k % 4 WHEN 0 THEN s = 'onCreate' WHEN 1 THEN s IN ('onCreate', 'onBind') WHEN 2 THEN s = 'onReceive' ELSE s IN ('onCreate', 'query') END""",
    "component_contexts": "SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN ['activity', 'service', 'receiver', 'provider'][s_nationkey % 4 + 1] END AS component_type FROM supplier",
    "app_prefix_members": "SELECT 'com.' || lower(p_type) || '.x' AS package, count(*) AS n FROM part GROUP BY p_type QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1",
    "listener_bridges": """WITH p AS (SELECT s_suppkey, s_nationkey, n_nationkey, CASE WHEN s_nationkey = n_nationkey THEN 2 ELSE 3 END AS tier FROM supplier JOIN nation ON s_suppkey % 7 = n_nationkey % 7)
SELECT CAST(s_suppkey AS VARCHAR) AS callsite, 'm' || n_nationkey AS callee, CASE tier WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM p QUALIFY tier = min(tier) OVER (PARTITION BY s_suppkey)""",
    "source_file_artifacts": """SELECT DISTINCT 'c' || conv_id AS class_name, 'file' AS kind, 'cacheDir/r' || role || '.db' AS value FROM conversations
UNION ALL SELECT class_name, 'log', value FROM (SELECT DISTINCT 'c' || conv_id AS class_name, turn, 'T' || turn || ':said' AS value FROM conversations) QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY turn) <= 30""",
    "source_intent_extras": """WITH u AS (SELECT DISTINCT event_type, user_id FROM events), x AS (
 SELECT event_type AS class_name, 'k' || (user_id % 5) AS name, 'int' AS type, true AS required, CAST(NULL AS VARCHAR) AS hint FROM u
 UNION ALL SELECT event_type, event_type, NULL, false, CAST(user_id AS VARCHAR) FROM u)
SELECT class_name, name, max(type) AS type, bool_or(required) AS required, count(DISTINCT hint) AS n_hints FROM x GROUP BY class_name, name""",
    "composed_flows": """WITH l AS (SELECT l_orderkey AS flow_id, l_linenumber AS pos, min(CASE WHEN l_returnflag = 'R' THEN '<android.p' ELSE '<p' END || l_partkey || '>') AS method FROM lineitem GROUP BY 1, 2),
c AS (SELECT l.*, coalesce(p_name, 'not analysed') AS summary, p_size / 100 AS confidence, p_size % 2 = 0 AS jadx FROM l LEFT JOIN part ON method = '<p' || p_partkey || '>')
SELECT flow_id, count(*) AS n_methods, string_agg(summary, ' → ' ORDER BY pos) AS summary, arg_max(method, pos) FILTER (method LIKE '<android.%') AS sink, round(coalesce(avg(confidence) FILTER (jadx), 0.5), 6) AS confidence FROM c GROUP BY flow_id""",
    "feasibility_rollup": """WITH f AS (SELECT o_custkey AS flow_id, CASE WHEN o_orderstatus = 'F' THEN 'full' WHEN o_totalprice > 480000 THEN 'blocked' ELSE 'partial' END AS f FROM orders)
SELECT flow_id, CASE WHEN bool_and(f = 'full') THEN 'full' WHEN bool_or(f = 'blocked') THEN 'blocked' ELSE 'partial' END AS feasibility FROM f GROUP BY flow_id""",
    "model_call_tabs": """SELECT 'All' AS tab, count(*) AS n, CAST(-2 AS BIGINT) AS first FROM events UNION ALL SELECT 'Recon', count(*), -1 FROM events WHERE event_type = 'view'
UNION ALL SELECT 's' || user_id, count(*), min(event_id) FROM events WHERE event_type <> 'view' GROUP BY user_id""",
    "permission_best": """WITH r AS (SELECT user_id, event_type || (event_id % 7) AS e, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT CAST(user_id AS VARCHAR) AS permission, string_agg(DISTINCT e, '|' ORDER BY e) AS evidence, max(value) AS confidence FROM r WHERE before IS NULL OR value > before GROUP BY user_id""",
    "confidence_histogram": "SELECT printf('%.1f', p_size / 50) AS confidence, count(*) AS n FROM part GROUP BY 1",
    "hints_with_fallback": """WITH c AS (SELECT DISTINCT s_nationkey AS k, 'n' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '$S' || s_suppkey ELSE '' END AS class FROM supplier)
SELECT class, coalesce((SELECT string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = k AND k % 3 = 0), '') AS hints FROM c""",
    "evidence_verified": "SELECT o_orderkey AS seed_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) THEN 'VERIFIED' ELSE 'FAILED' END AS status FROM orders",
    "timeline_order": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events",
    "catalog_pattern_scores": _catalog_scores(),
    "hit_investigability": """SELECT o_orderkey, round(CAST(CASE WHEN o_orderstatus = 'F' THEN 0.25 ELSE 0 END + CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 13 <= 3 THEN 0.15 WHEN o_orderkey % 13 <= 6 THEN 0.10 WHEN o_orderkey % 13 <= 10 THEN 0.05 ELSE 0 END
  + CASE WHEN o_custkey % 2 = 1 THEN 0.20 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 0.10 ELSE 0 END + CASE WHEN o_custkey % 3 > 0 AND o_custkey % 5 > 0 THEN 0.20 ELSE 0 END AS DOUBLE), 6) AS score,
  o_custkey % 3 > 0 AND o_custkey % 5 > 0 AS reflection_free, concat_ws('|', CASE WHEN o_custkey % 3 = 0 THEN 'java.lang.Class.forName' END, CASE WHEN o_custkey % 5 = 0 THEN 'dalvik.system.DexClassLoader' END) AS sites FROM orders""",
    "preview_shared_out": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN 'CRITICAL' WHEN o_orderkey % 500 < 5 THEN 'HIGH' WHEN o_orderkey % 500 < 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM orders),
h AS (SELECT p, k, q, count(priority) AS have FROM (VALUES ('CRITICAL', 1, 400), ('HIGH', 2, 300), ('MEDIUM', 3, 200), ('LOW', 4, 100)) x(p, k, q) LEFT JOIN o ON priority = p GROUP BY p, k, q),
a AS (SELECT p, k, have, least(have, q) AS t1 FROM h),
b AS (SELECT *, t1 + CASE WHEN sum(have - t1) OVER () > 0 THEN least(have - t1, CAST(floor((1000 - sum(t1) OVER ()) * (have - t1) / sum(have - t1) OVER ()) AS BIGINT)) ELSE 0 END AS t2 FROM a),
c AS (SELECT *, t2 + greatest(0, least(have - t2, 1000 - sum(t2) OVER () - coalesce(sum(have - t2) OVER (ORDER BY have - t2 DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM b)
SELECT o_orderkey, priority FROM o JOIN c ON p = priority QUALIFY row_number() OVER (PARTITION BY priority ORDER BY o_orderkey) <= take""",
    "extraction_coverage": """WITH o AS (SELECT o_custkey, count(*) AS c, count(*) FILTER (o_orderstatus = 'F') AS g, count(*) FILTER (o_orderstatus = 'P') AS a FROM orders GROUP BY o_custkey),
x AS (SELECT c_custkey, c_mktsegment, coalesce(c, 0) AS c, coalesce(g, 0) AS g, coalesce(a, 0) AS a FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN c > 0 AND g > 0 AND c_mktsegment = 'BUILDING' AND a = 0 THEN 'COMPLETE' WHEN c = 0 AND g = 0 THEN 'MINIMAL' ELSE 'PARTIAL' END AS level, CASE WHEN c = 0 THEN g > 0 ELSE abs(c - g) / c > 0.3 END AS drifted FROM x""",
    "ioc_domains": r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b')) AS domain FROM documents",
    "ioc_urls": "SELECT page_id, url FROM pages UNION SELECT page_id, regexp_replace(url, '^http', 'HTTP') FROM pages",
    "method_usage": "SELECT l_partkey AS method, count(*) AS n, count(DISTINCT l_orderkey) AS n_flows FROM lineitem GROUP BY l_partkey",
    "call_texts": f"WITH {_EDGES} SELECT caller, callee, 'line ' || min(ord) AS callsite FROM edges GROUP BY caller, callee",
    "flow_inputs": "SELECT user_id AS flow_id, event_type AS type, CAST(event_id % 3 AS VARCHAR) AS name, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type, event_id % 3",
    "callback_edges": "SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'site' || (s_suppkey % 9) ELSE '<app.N' || s_nationkey || ': void onCreate()>' END AS caller, 'm' || s_suppkey AS callee FROM supplier WHERE s_suppkey % 3 = 0 OR s_nationkey < 20",
    "kept_cases": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 500000 ELSE 0 END >= 0.5)",
    "fallback_cases": f"WITH {_GROUPS} SELECT 'CASE-GRP-' || substr(sha1(caller), 1, 8) AS case_id, 'grp-' || sha1(caller) AS group_id, row_number() OVER (ORDER BY ord, 'grp-' || sha1(caller)) AS place FROM groups",
    "changed_runs": "SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > 0",
    "bare_runs": "SELECT c_custkey AS run_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "bundle_keys": "SELECT CASE WHEN o_orderkey % 4 > 0 THEN 'CASE:' || o_custkey || ':' || o_orderstatus ELSE 'SINGLE:' || o_orderkey END AS key, count(*) AS n FROM orders GROUP BY 1",
    "api_permissions": f"WITH {_EDGES}, s AS (SELECT DISTINCT callee AS signature FROM edges) SELECT signature, concat_ws('|', CASE WHEN contains(signature, 'promo.') THEN 'P1' END, CASE WHEN contains(signature, '.P7') THEN 'P2' END, CASE WHEN contains(signature, 'economy') THEN 'P3' END, CASE WHEN contains(signature, 'P77') THEN 'P4' END) AS permissions FROM s",
    "rule_subset": "WITH s AS (SELECT DISTINCT '<tpch.' || lower(p_type) || '.P' || (p_partkey % 100) || ': void call(int)>' AS signature, p_brand AS category_id FROM part) SELECT * FROM s WHERE lower(signature) LIKE '%p1%' OR lower(signature) LIKE '%promo%'",
    "framework_flags": "SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 AND s_suppkey % 4 = 0 AS is_framework FROM supplier",
    "safe_ids": "SELECT page_id, left(trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), '._-'), 60) AS id FROM pages",
    "printable_runs": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x20-\x7e]{4,}')) AS BIGINT) AS n FROM documents",
    "best_claims": "SELECT o_custkey, arg_max(o_orderkey, (round(o_totalprice / 500000, 1), -o_orderkey)) AS o_orderkey, max(round(o_totalprice / 500000, 1)) AS confidence FROM orders GROUP BY o_custkey",
    "hand_off_errors": "SELECT * FROM (SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice >= 400000 THEN 'price' END, CASE WHEN o_custkey % 10 = 0 THEN 'customer' END) AS errors FROM orders) WHERE errors <> ''",
}
