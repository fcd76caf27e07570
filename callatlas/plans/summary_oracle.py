"""DuckDB SQL for the queries of summary_queries, written on the raw tables."""

from __future__ import annotations

from ..functions import hints as H
from ..functions import text as X
from ..operators.components import BASE_METHODS
from .oracle import SQL, _EDGES, _flags


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


_G = """g AS (SELECT 'u' || user_id AS analysis_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS group_id, min(event_id) AS ord, list_sort(list(DISTINCT event_type)) AS c,
  CAST(date_part('day', CAST(ts AS DATE)) AS BIGINT) AS d FROM events GROUP BY user_id, CAST(ts AS DATE))"""
_NAMES = "concat_ws('|', CASE WHEN p0 THEN 'P_ALL' END, CASE WHEN p1 THEN 'P_ANY' END, CASE WHEN p2 THEN 'P_TWICE' END, CASE WHEN p3 THEN 'P_COUNT' END, 'P_EMPTY')"
_N = "CAST(p0 AS BIGINT) + CAST(p1 AS BIGINT) + CAST(p2 AS BIGINT) + CAST(p3 AS BIGINT) + 1"


def _union(key: str, source: str = "g", more: str = "") -> str:
    return f"u AS (SELECT {key}, count(*) AS n_groups, list_sort(list_distinct(flatten(list(c)))) AS c{more} FROM {source} GROUP BY {key})"


_CASES = """m AS (SELECT o_custkey AS k, CAST(o_orderkey % 1000 AS VARCHAR) AS hit_id FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT o_custkey, CAST(l_partkey AS VARCHAR) FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
s AS (SELECT k, count(*) AS n FROM m GROUP BY k), x AS (SELECT hit_id, k, coalesce(nullif(k % 6, 0), 9999) AS priority, n FROM m JOIN s USING (k))"""
_THREADS = """e AS (SELECT 'a' || (l_suppkey % 3) AS a, '<s.S' || l_suppkey || ': void m()>' AS caller, CASE WHEN l_linenumber < 6 THEN 'at ' || (l_orderkey % 997) || '/' || l_linenumber END AS callsite, l_returnflag = 'R' AS made,
  l_partkey % 5 AS kind, l_partkey % 7 = 0 OR l_partkey % 50 % 3 = 0 AS thread, l_partkey % 50 % 4 = 0 AS runnable FROM lineitem),
b AS (SELECT DISTINCT a, caller, callsite FROM e WHERE kind = 2 AND callsite IS NOT NULL AND (thread OR runnable OR made)),
miss AS (SELECT a, caller, callsite FROM e WHERE kind < 2 AND thread AND callsite IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.a = e.a AND b.caller = e.caller AND b.callsite = e.callsite))"""

SQL.update({
    "app_patterns": f"WITH {_G}, {_union('analysis_id')}, {_flags('u')} SELECT analysis_id, n_groups, array_to_string(c, '|') AS categories, {_NAMES} AS patterns FROM flags",
    "app_pattern_examples": f"""WITH {_G}, {_union('analysis_id')}, {_flags('u')}, ev AS (
  SELECT analysis_id, 'P_ALL' AS pattern_id, unnest(['click', 'purchase']) AS category FROM flags WHERE p0
  UNION ALL SELECT analysis_id, 'P_ANY', unnest(['error', CASE WHEN list_contains(c, 'signup') THEN 'signup' ELSE 'view' END]) FROM flags WHERE p1
  UNION ALL SELECT analysis_id, 'P_TWICE', unnest(['view', CASE WHEN list_contains(c, 'click') THEN 'click' ELSE 'signup' END, CASE WHEN list_contains(c, 'error') THEN 'error' ELSE 'purchase' END]) FROM flags WHERE p2
  UNION ALL SELECT analysis_id, 'P_COUNT', unnest(list_sort(list_intersect(c, ['click', 'view', 'signup', 'error']))[1:3]) FROM flags WHERE p3),
one AS (SELECT analysis_id, category, arg_min(group_id, ord) AS group_id FROM (SELECT analysis_id, group_id, ord, unnest(c) AS category FROM g) GROUP BY analysis_id, category)
SELECT analysis_id, pattern_id, category, group_id FROM ev JOIN one USING (analysis_id, category)""",
    "package_patterns": f"""WITH {_G}, h AS (SELECT *, 'm' || substr(group_id, 1, 7) AS package FROM g), {_union('analysis_id, package', 'h', ", arg_min(group_id, ord) AS first")}, {_flags('u')},
r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {_N} DESC, n_groups DESC, package) AS place FROM flags)
SELECT analysis_id, package, n_groups, array_to_string(c, '|') AS categories, package || '.D' || first AS first_class, place FROM r WHERE place <= 2""",
    "entrypoint_patterns": f"""WITH {_G}, h AS (SELECT *, CASE WHEN d % 7 = 0 THEN 'root' WHEN d % 3 > 0 THEN 'e' || substr(group_id, 1, 7) END AS entrypoint, CASE WHEN d % 7 = 0 THEN 1 WHEN d % 4 > 0 THEN d % 5 END AS len FROM g),
{_union('analysis_id, entrypoint', "(SELECT * FROM h WHERE entrypoint IS NOT NULL)", ", arg_min(group_id, (coalesce(len, 99), ord)) AS example, min(len) AS shortest")}, {_flags('u')}
SELECT analysis_id, entrypoint, n_groups, array_to_string(c, '|') AS categories, {_N} AS n_patterns, example, shortest FROM flags""",
    "pattern_level_summary": f"""WITH {_G}, {_flags('g')}, t AS (SELECT analysis_id, count(*) AS n, count(*) FILTER (p0) AS a, count(*) FILTER (p1) AS b, count(*) FILTER (p2) AS c, count(*) FILTER (p3) AS d FROM flags GROUP BY analysis_id)
SELECT analysis_id, n, n AS n_with_patterns, concat_ws('|', CASE WHEN a > 0 THEN 'P_ALL:' || a END, CASE WHEN b > 0 THEN 'P_ANY:' || b END, CASE WHEN c > 0 THEN 'P_TWICE:' || c END, CASE WHEN d > 0 THEN 'P_COUNT:' || d END, 'P_EMPTY:' || n) AS counts FROM t""",
    "block_places": """SELECT o_custkey AS analysis_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, floor(o_totalprice / 50000) DESC, o_orderkey % 4 DESC, o_orderkey) AS place
FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0""",
    "inventory_preview": """WITH i AS (SELECT l_suppkey % 20 AS analysis_id, 'p' || (l_partkey % 200) AS package, count(*) AS h, count(DISTINCT l_orderkey) AS m FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT * FROM (SELECT analysis_id, package, row_number() OVER (PARTITION BY analysis_id ORDER BY h DESC, m DESC, package) AS place FROM i) WHERE place <= 10""",
    "callgraph_counts": f"""WITH {_EDGES}, n AS (SELECT c_nationkey AS k, count(*) AS n_nodes FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, edge_source, count(*) AS n FROM edges GROUP BY 1, 2),
e AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_edges, string_agg(edge_source || ':' || n, '|' ORDER BY edge_source) AS sources FROM s GROUP BY k),
p AS (SELECT s_nationkey AS k, list_sort(list(DISTINCT caller)) AS c FROM edges WHERE l_suppkey % 2 = 0 GROUP BY 1)
SELECT 'n' || k AS analysis_id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, sources, coalesce(len(c), 0) AS n_entrypoints, array_to_string(c[1:2], '|') AS entrypoints FROM n FULL JOIN e USING (k) FULL JOIN p USING (k)""",
    "class_kinds": """WITH c AS (SELECT s_nationkey AS n, s_suppkey % 6 AS k, count(*) AS x FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1, 2), top AS (SELECT n, k FROM c QUALIFY x = max(x) OVER (PARTITION BY n))
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'component' WHEN s_nationkey % 4 = 2 AND s_suppkey % 6 = 1 THEN 'ignored' WHEN EXISTS (SELECT 1 FROM top WHERE n = s_nationkey AND k = s_suppkey % 6) THEN 'app' ELSE 'library' END AS kind FROM supplier""",
    "app_neighbours": """WITH m AS (SELECT l_suppkey, CASE l_partkey % 3 WHEN 1 THEN '<my.app.kotlin.P' ELSE '<other.P' END || l_partkey || ': void m()>' AS m, l_partkey % 3 > 0 AS own FROM lineitem)
SELECT l_suppkey, coalesce(array_to_string(list_sort(list(DISTINCT m) FILTER (own))[1:5], '|'), '') AS methods FROM m GROUP BY l_suppkey""",
    "app_path_methods": "SELECT DISTINCT l_suppkey % 5 AS analysis_id, CASE l_partkey % 4 WHEN 1 THEN '<javaz.P' ELSE '<a.java.P' END || l_partkey || ': void m()>' AS method FROM lineitem WHERE l_partkey % 2 = 1",
    "referenced_components": """WITH r AS (SELECT s_nationkey AS n, s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 'T' END || s_suppkey AS component FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))
SELECT n AS analysis_id, component FROM r WHERE n % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = s AND c_nationkey = n)
UNION ALL SELECT n, component FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s) AS i FROM r WHERE n % 2 = 1) WHERE i <= 3""",
    "case_sizes": f"WITH {_CASES} SELECT 'c' || k AS case_id, n AS n_hits FROM s",
    "case_of_hit": f"WITH {_CASES} SELECT hit_id, 'c' || k AS case_id, priority, n AS total_case_hits FROM x QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY priority, k) = 1",
    "case_call_sites": f"""WITH {_CASES}, f AS (SELECT hit_id, min(k) AS k FROM m GROUP BY hit_id), l AS (SELECT l_partkey, max(l_orderkey) AS g FROM lineitem GROUP BY l_partkey)
SELECT hit_id, 'c' || k AS case_id, CAST(g AS VARCHAR) AS group_id, p_type FROM f JOIN part ON CAST(p_partkey AS VARCHAR) = hit_id AND p_size % 2 = 0 LEFT JOIN l ON l_partkey = p_partkey""",
    "case_group_ids": """SELECT CAST(min(o_orderkey) AS VARCHAR) AS group_id FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey
UNION SELECT CAST(max(l_orderkey) AS VARCHAR) FROM lineitem WHERE l_partkey IN (SELECT o_orderkey % 1000 FROM orders WHERE o_custkey % 2 = 0 AND o_orderpriority = '1-URGENT') GROUP BY l_partkey""",
    "bundle_priorities": f"WITH {_CASES}, b AS (SELECT hit_id, min(priority) AS p FROM x GROUP BY hit_id) SELECT CAST(p_partkey AS VARCHAR) AS seed_id, least(coalesce(p, 9999), CASE WHEN p_size % 3 = 0 THEN p_size % 7 ELSE 9999 END) AS priority FROM part LEFT JOIN b ON hit_id = CAST(p_partkey AS VARCHAR)",
    "thread_validation": f"""WITH {_THREADS} SELECT a AS analysis_id, CAST(17 AS BIGINT) AS n_threads, CAST(8 AS BIGINT) AS n_runnables, count(*) FILTER (kind < 2 AND thread) AS n_starts, count(*) FILTER (made) AS n_synthetic,
(SELECT count(*) FROM miss WHERE miss.a = e.a) AS n_missing FROM e GROUP BY a""",
    "thread_missing_runs": f"WITH {_THREADS} SELECT a AS analysis_id, caller, callsite, count(*) AS n FROM miss GROUP BY ALL",
    "threading_bridges": """WITH c AS (SELECT l_suppkey AS s, 'q' || (l_suppkey % 4) AS q, l_partkey % 100 AS p, l_orderkey || '/' || l_linenumber AS site FROM lineitem),
x AS (SELECT *, p % 3 = 0 AS started, p % 3 = 0 AND (p % 8 = 0 OR p % 20 = 0) AS own, p % 4 > 0 AND p % 7 = 0 AS made, p % 4 > 0 AND p % 11 = 0 AS typed, '<' || q || '.S' || s || ': void m()>' AS caller FROM c),
k AS (SELECT *, CASE WHEN started THEN 'thread_runnable' WHEN p % 3 = 1 THEN 'handler_post' ELSE 'executor_execute' END AS pattern FROM x WHERE NOT own AND (NOT started OR p % 7 = 0 OR p % 11 = 0)),
near AS (SELECT s_suppkey AS s, 'q' || (s_suppkey % 4) AS q, 'q' || (s_suppkey % 4) || '.S' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '$1' ELSE '' END AS class FROM supplier WHERE s_suppkey % 3 = 0),
two AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY q ORDER BY class) <= 2),
e AS (SELECT caller, '<T' || p || ': void run()>' AS callee, 'thread_start' AS pattern, CASE WHEN p % 8 = 0 THEN 'high' ELSE 'medium' END AS confidence, site FROM x WHERE own
  UNION ALL SELECT caller, '<R' || p || ': void run()>', pattern, CASE WHEN made THEN 'high' ELSE 'medium' END, site FROM k WHERE made OR typed
  UNION ALL SELECT caller, '<' || class || ': void run()>', pattern, 'low', site FROM k JOIN near ON near.s = k.s WHERE NOT made AND NOT typed AND k.s % 6 = 0
  UNION ALL SELECT caller, '<' || class || ': void run()>', pattern, 'low', site FROM k JOIN two ON two.q = k.q WHERE NOT made AND NOT typed AND k.s % 6 > 0)
SELECT caller, callee, pattern, confidence, count(DISTINCT site) AS n FROM e GROUP BY caller, callee, pattern, confidence""",
    "augmented_edge_counts": f"WITH {_EDGES} SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'flowdroid_callback' ELSE edge_source END AS edge_source, count(*) AS n FROM edges WHERE NOT (l_suppkey % 2 = 0 AND ord % 3 = 0) GROUP BY 1",
    "page_string_categories": r"""WITH t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(concat_ws(' ', html, '"', url, '"'), '"([^"]*)"', 1)) AS x FROM pages), l AS (SELECT page_id, lower(x) AS x FROM t),
h AS (SELECT page_id, 'SOCIAL_ENGINEERING_PERMISSION_LURE_SETTINGS' AS category_id, 'page' AS i FROM l WHERE contains(x, 'page') AND (length(x) >= 5 OR x = 'page')
  UNION SELECT page_id, 'C2_MESSAGING_PLATFORM_ENDPOINTS', 'utf-8' FROM l WHERE regexp_matches(x, '(^|[^a-z0-9.\-])utf-8($|[^a-z0-9.\-])')
  UNION SELECT page_id, 'C2_MESSAGING_PLATFORM_ENDPOINTS', 'example.net/' FROM l WHERE regexp_matches(x, '(^|[^a-z0-9])example\.net/($|[^a-z0-9])'))
SELECT page_id, category_id, string_agg(i, '|' ORDER BY i) AS indicators FROM h GROUP BY page_id, category_id""",
    "field_constants": f"WITH f(i, v) AS (VALUES {_values(enumerate(X.FIELD_VALUES.values()))}) SELECT o_orderkey, 'x' || (o_orderkey % 5) || coalesce('|' || v, '') AS texts FROM orders LEFT JOIN f ON i = o_orderkey % 8",
    "versioned_constants": f"""WITH e(i, enum_class) AS (VALUES {_values(enumerate(H.VERSIONED))}), k(enum_class, value, semantic, added, deprecated) AS (VALUES {_values(H.VERSIONED_ROWS)})
SELECT p_partkey, semantic, CAST(CASE WHEN semantic IS NULL THEN NULL WHEN added > p_partkey % 37 THEN 0.7 WHEN deprecated <= p_partkey % 37 THEN 0.5 ELSE 0.95 END AS DOUBLE) AS confidence
FROM part JOIN e ON i = p_partkey % 5 LEFT JOIN k ON k.enum_class = e.enum_class AND value = p_size % 12 + CASE WHEN p_partkey % 5 = 2 THEN 98 ELSE 0 END""",
    "resolved_methods": "SELECT CAST(a.p_partkey AS VARCHAR) AS class, CAST(b.p_partkey AS VARCHAR) AS owner FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 4 AND a.p_partkey % 4 <= a.p_partkey % 10",
    "inherited_entrypoints": f"""WITH b(i, name) AS (VALUES {_values((i, n) for i, base in enumerate(sorted(BASE_METHODS)) for n in BASE_METHODS[base])})
SELECT '<a.P' || p_partkey || ': void ' || name || '()>' AS method FROM part JOIN b ON i = p_partkey % 9 WHERE name IN ('onCreate', 'onReceive', 'query', 'onBind', 'helper', 'onAttach', 'onHandleIntent', 'onInterrupt')""",
    "resolved_values": """WITH n AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
SELECT a.l_orderkey, a.place, coalesce('new S' || b.l_suppkey, 'v0') AS resolved FROM n a LEFT JOIN n b ON b.l_orderkey = a.l_orderkey AND b.place = a.place - a.place % 3""",
    "path_hints": """WITH h AS (SELECT o_orderkey, 'f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.db' WHEN 1 THEN '*.db' WHEN 2 THEN '.x_' ELSE '' END AS f, CASE WHEN o_orderkey % 5 > 0 THEN 'c' || o_custkey END AS p FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '/' || f WHEN 1 THEN '/data/data/' || p || '/cache/' || f WHEN 2 THEN '/data/data/' || p || '/files/' || f WHEN 3 THEN '/sdcard/Android/data/' || p || '/cache/' || f WHEN 4 THEN '/sdcard/Android/data/' || p || '/files/' || f END AS path,
o_orderkey % 4 = 0 AS stable FROM h""",
    "extra_flags": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN '--es' WHEN 1 THEN '--ei' WHEN 2 THEN '--el' WHEN 3 THEN '--ez' END AS flag, event_id % 8 IN (0, 1, 2, 3, 6) AS injectable FROM events",
    "component_names": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'p.q.S' || s_suppkey WHEN 1 THEN 'r.S' || s_suppkey WHEN 2 THEN 'm.n.S' || s_suppkey WHEN 3 THEN 'S' || s_suppkey END AS component FROM supplier",
    "seed_warnings": """WITH w AS (SELECT o_orderkey, o_orderkey % 4 = 0 AS unnamed, o_orderkey % 3 = 0 AS untyped, o_orderkey % 10 < 5 AS low, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 3 END AS bad, o_orderkey % 5 AS facts, o_orderkey % 7 AS doubts FROM orders)
SELECT o_orderkey, concat_ws('|', CASE WHEN unnamed THEN 'missing_component_name' END, CASE WHEN untyped THEN 'unknown_component_type' END, CASE WHEN low THEN 'low_confidence' END, CASE WHEN bad > 0 THEN 'non_injectable_extra' END, CASE WHEN bad > 1 THEN 'non_injectable_extra' END,
  CASE WHEN facts = 0 THEN 'no_facts' END, CASE WHEN doubts > facts THEN 'high_uncertainty' END) AS warnings,
CASE WHEN unnamed OR facts = 0 OR (low AND (untyped OR bad > 0)) THEN 'manual' WHEN untyped OR bad > 0 OR low THEN 'partial' ELSE 'full' END AS automation FROM w""",
    "latest_runs": "SELECT user_id AS analysis_id, arg_max(event_type, (ts, event_type)) AS run_id FROM events GROUP BY user_id",
    "signature_index": "SELECT p_brand AS signature, arg_max(p_type, p_partkey) AS category_id FROM part GROUP BY p_brand",
    "case_facts": """SELECT conv_id AS case_id, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS BIGINT) AS fact_index, fact, count(*) AS n FROM conversations, (VALUES ('a'), ('b')) f(fact) WHERE turn = 0 GROUP BY conv_id, fact
UNION ALL SELECT conv_id, role, i, 'f', count(*) FROM conversations, range(0, 2) r(i) WHERE i < turn % 3 GROUP BY conv_id, role, i""",
    "merged_guidance": "SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey || '|x' END, '|' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS steps, string_agg(CAST(l_suppkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS manual_steps FROM lineitem GROUP BY l_orderkey",
    "requirement_outputs": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS seed_id, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN c_mktsegment ELSE 'unknown' END AS category,
CASE WHEN c_custkey % 3 > 0 THEN 'C' || c_nationkey ELSE '' END AS component_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
})
