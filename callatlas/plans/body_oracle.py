"""DuckDB SQL for the queries of body_queries: the edges that each kind of order has to give, from the raw table."""

from __future__ import annotations

from ..functions.constants import CONSTANT_ALIASES, METHOD_ALIASES
from .oracle import SQL

_ORDERS = "o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey % 10 AS c FROM orders)"
_COUNT = "SELECT target, pattern, confidence, count(*) AS n, count(DISTINCT o_orderkey) AS callers FROM e GROUP BY target, pattern, confidence"

SQL |= {
    "found_threading_edges": f"""WITH {_ORDERS},
p(k, pattern, confidence) AS (VALUES (1, 'thread_runnable', 'high'), (2, 'handler_post', 'medium'), (3, 'handler_message', 'high'), (4, 'executor_execute', 'high')),
near(target) AS (VALUES ('q.R1'), ('q.R2'), ('q.R4'), ('q.R5'), ('q.R7'), ('q.R8'), ('q.S0$1'), ('q.S4$1'), ('q.S8$1'), ('q.T0'), ('q.T2'), ('q.T4'), ('q.T6'), ('q.T8')),
e AS (
  SELECT o_orderkey, 'q.T' || (c - c % 2) AS target, 'thread_start' AS pattern, CASE k WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM o WHERE k = 0 OR (k = 7 AND c < 5)
  UNION ALL SELECT o_orderkey, 'q.R' || c, pattern, confidence FROM o JOIN p USING (k) WHERE c % 3 > 0
  UNION ALL SELECT o_orderkey, 'q.S' || c || '$1', pattern, 'low' FROM o JOIN p USING (k) WHERE c % 3 = 0 AND c % 4 = 0
  UNION ALL SELECT o_orderkey, near.target, pattern, 'low' FROM o JOIN p USING (k), near WHERE c % 3 = 0 AND c % 4 > 0) {_COUNT}""",
    "found_listener_edges": f"""WITH {_ORDERS}, near(target) AS (VALUES ('q.L0'), ('q.L2'), ('q.L4')),
e AS (
  SELECT o_orderkey, 'q.L' || c AS target, 'setOnClickListener' AS pattern, CASE k WHEN 5 THEN 'high' ELSE 'medium' END AS confidence FROM o WHERE k IN (5, 6) AND c % 2 = 0
  UNION ALL SELECT o_orderkey, 'q.S' || c || '$L', 'setOnClickListener', 'low' FROM o WHERE k IN (5, 6) AND c % 4 = 1
  UNION ALL SELECT o_orderkey, near.target, 'setOnClickListener', 'low' FROM o, near WHERE k IN (5, 6) AND c % 4 = 3) {_COUNT}""",
}


def _pairs(table: dict) -> str:
    return ", ".join(f"('{k}', '{name}')" for k, names in table.items() for name in names)


_GROUNDING = rf"""units AS (
  SELECT l_orderkey, l_linenumber, 'virtualinvoke $m.<q.P' || (l_partkey % 20) || ': void ' || CASE WHEN l_linenumber % 3 = 1 THEN 'setAudioSource' ELSE 'addView' END || '(int)>('
    || CASE WHEN l_partkey % 2 = 0 THEN l_linenumber ELSE 2038 END || ') 10.' || (l_partkey % 5) || '.0.9' AS stmt FROM lineitem),
near AS (SELECT c_custkey AS o_custkey, ['http://h' || (c_custkey % 4) || '.example.com/x', 'see site' || (c_custkey % 2) || '.org'] AS strings FROM customer),
said AS (SELECT l_orderkey AS o_orderkey, string_agg(stmt, ' ' ORDER BY l_linenumber) AS said FROM units GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey, o_custkey, ['records the Microphone', 'shows an application_overlay over all of the others', 'unrelated words only here', 'calls q.p', 'type_phone setaudiosource'][o_orderkey % 5 + 1]
      || ' sent to http://h' || (o_custkey % 7) || '.example.com/x or 10.' || (o_orderkey % 6) || '.7.7 and cdn.site' || (o_custkey % 3) || '.org' AS fact, coalesce(strings, []) AS strings,
    CASE WHEN o_orderkey % 11 > 0 THEN coalesce(said, '') || CASE WHEN o_orderkey % 7 = 0 AND said IS NOT NULL THEN ' ' ELSE '' END ELSE '' END AS said, o_orderkey % 11 > 0 AND o_orderkey % 7 = 0 AS gone
  FROM orders LEFT JOIN said USING (o_orderkey) LEFT JOIN near USING (o_custkey)),
numbers AS (
  SELECT DISTINCT o_orderkey, unnest(list_concat(regexp_extract_all(said, '\((\d+)\)', 1), regexp_extract_all(said, '=\s*(\d+)\s*[;,)]', 1), list_transform(regexp_extract_all(said, '\(-(\d+)\)', 1), lambda x: '-' || x))) AS k FROM facts),
names AS (
  SELECT o_orderkey, list(name) AS names FROM (
    SELECT o_orderkey, name FROM numbers JOIN (VALUES {_pairs(CONSTANT_ALIASES)}) c(k, name) USING (k)
    UNION SELECT o_orderkey, name FROM facts JOIN (VALUES {_pairs(METHOD_ALIASES)}) m(k, name) ON contains(lower(said), k)) GROUP BY o_orderkey),
words AS (
  SELECT f.*, list_filter(regexp_extract_all(lower(fact), '[a-zA-Z0-9_.$]+'), lambda w: length(w) > 2) AS tokens, list_concat(coalesce(names, []), list_filter(regexp_split_to_array(lower(said), '\s+'), lambda w: w <> '')) AS vocabulary
  FROM facts f LEFT JOIN names USING (o_orderkey)),
counted AS (
  SELECT *, len(list_filter(tokens, lambda t: contains(lower(said), t))) AS direct,
    len(list_filter(tokens, lambda t: contains(lower(said), t) OR len(list_filter(vocabulary, lambda v: contains(v, t) OR contains(t, v))) > 0)) / len(tokens) AS ratio FROM words),
found AS (
  SELECT *, regexp_extract_all(fact, 'https?://[^\s"<>]+') AS urls, regexp_extract_all(fact, '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b') AS ips, regexp_extract_all(fact, '\b[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}\b') AS domains FROM counted),
addresses AS (
  SELECT o_orderkey, o_custkey, 1 AS place, 'url' AS label, unnest(urls) AS m, NULL AS part, said, strings FROM found
  UNION ALL SELECT o_orderkey, o_custkey, 2, 'ip', x, array_to_string(string_split(x, '.')[1:2], '.'), said, strings FROM (SELECT *, unnest(ips) AS x FROM found)
  UNION ALL SELECT o_orderkey, o_custkey, 3, 'domain', x, array_to_string(string_split(x, '.')[-2:], '.'), said, strings FROM (SELECT *, unnest(domains) AS x FROM found)),
missed AS (
  SELECT * FROM addresses WHERE NOT list_contains(strings, m) AND NOT contains(said, m) AND (part IS NULL OR (NOT contains(said, part) AND len(list_filter(strings, lambda s: contains(s, part))) = 0)))"""

SQL |= {
    "claim_grounding": f"""WITH {_GROUNDING}
SELECT 'c' || o_custkey AS seed_id, o_orderkey AS idx, -1 AS place, 'error' AS severity, 'missing unit gone-' || o_orderkey AS reason, CAST(NULL AS DOUBLE) AS overlap_ratio FROM counted WHERE gone
UNION ALL SELECT 'c' || o_custkey, o_orderkey, 0, CASE WHEN ratio < 0.2 THEN 'warning' ELSE 'info' END, CASE WHEN ratio < 0.2 THEN printf('Low token overlap (%.1f%% < 20%%)', ratio * 100) ELSE printf('Moderate token overlap (%.1f%%)', ratio * 100) END, round(ratio, 9)
  FROM counted WHERE said <> '' AND ratio < 0.5
UNION ALL SELECT 'c' || o_custkey, o_orderkey, place, 'warning', label || ' ''' || m || ''' not directly present in slice or strings', NULL FROM missed""",
    "claim_verdicts_strict": f"""WITH {_GROUNDING},
bad AS (
  SELECT o_custkey, 1 AS n FROM counted WHERE said <> '' AND direct = 0 UNION ALL SELECT o_custkey, 1 FROM missed),
n AS (SELECT o_custkey, count(*) AS n FROM bad GROUP BY o_custkey),
g AS (SELECT o_custkey, string_agg('gone-' || o_orderkey, '|' ORDER BY 'gone-' || o_orderkey) AS missing FROM counted WHERE gone GROUP BY o_custkey)
SELECT 'c' || o_custkey AS seed_id, n IS NULL AND missing IS NULL AS ok, coalesce(missing, '') AS missing, coalesce(n, 0) AS n_mismatched, CAST(0 AS BIGINT) AS n_warnings
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN n USING (o_custkey) LEFT JOIN g USING (o_custkey)""",
}

SQL["ir_summaries"] = """WITH u AS (
  SELECT CAST(date_part('year', o_orderdate) AS VARCHAR) AS analysis_id, 'm' || l_partkey AS method, l_orderkey * 8 + l_linenumber AS idx,
    CASE l_linenumber % 3 WHEN 0 THEN 'virtualinvoke $m.<q.S' || (l_suppkey % 9) || ': void f()>()' WHEN 1 THEN '$f = r0.<q.P: int f' || (l_suppkey % 9) || '>' ELSE '' END AS stmt
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, method ORDER BY idx, stmt) AS n, count(*) OVER (PARTITION BY analysis_id, method) AS unit_count FROM u)
SELECT analysis_id, method, coalesce(string_agg(stmt, '|' ORDER BY n) FILTER (stmt <> ''), '') AS statements, coalesce(string_agg(regexp_extract(stmt, '<([^>]+)>', 1), '|' ORDER BY n) FILTER (stmt LIKE '%invoke%'), '') AS invoked,
  coalesce(string_agg(stmt, '|' ORDER BY n) FILTER (contains(stmt, '.<') AND contains(stmt, ': ')), '') AS fields, unit_count, unit_count > 4 AS truncated
FROM n WHERE n <= 4 GROUP BY analysis_id, method, unit_count"""
