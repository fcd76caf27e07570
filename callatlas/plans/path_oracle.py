"""DuckDB SQL for the queries of path_queries, on the raw tables."""

from __future__ import annotations

from .oracle import SQL, _DIST

SQL |= {
    "control_flow_paths": f"""WITH {_DIST},
sinks AS (
  SELECT 's' || s_suppkey AS caller, CASE WHEN s_suppkey % 3 > 0 THEN 'n' || s_nationkey ELSE 'api' || s_suppkey END AS callee, true AS own, false AS known FROM supplier
  UNION ALL SELECT 'z' || s_suppkey, 'n' || s_nationkey, false, s_suppkey % 20 = 0 FROM supplier WHERE s_suppkey % 10 = 0),
led AS (SELECT s.*, d.dist, string_split(d.path, '>') AS p FROM sinks s LEFT JOIN d ON d.method = s.caller),
steps AS (
  SELECT led.caller, i, 'at ' || p[i] || ' ' || p[i + 1] || '/' || CASE p[i][1] WHEN 'c' THEN 'soot_cg' WHEN 'p' THEN 'jimple_invoke' ELSE 'threading_synthetic' END || '/' || w AS e
  FROM led, range(1, len(p)) r(i), g WHERE g.caller = p[i] AND g.callee = p[i + 1]),
along AS (SELECT caller, string_agg(e, '|' ORDER BY i) AS edges FROM steps GROUP BY caller),
guard AS (
  SELECT 's' || l_suppkey AS caller, l_orderkey * 8 + l_linenumber AS idx, l_orderkey || '-' || l_linenumber AS unit_id,
    CASE WHEN l_linenumber % 4 = 1 THEN 'if $i == ' || l_quantity || ' goto 3' ELSE ' switch ' || l_partkey END AS stmt FROM lineitem WHERE l_linenumber % 4 IN (1, 2)),
guards AS (SELECT caller, count(*) AS n, arg_min(stmt, idx) AS first_guard, arg_max(unit_id, idx) AS last_guard FROM guard GROUP BY caller)
SELECT led.caller AS sink_id, CASE WHEN dist IS NULL THEN 'partial' ELSE 'full' END AS status, dist IS NOT NULL AS reachable, CASE WHEN dist IS NOT NULL THEN len(p) END AS path_len,
  CAST(dist + CASE WHEN g.w IS NOT NULL THEN g.w ELSE 0 END AS BIGINT) AS path_cost, CASE WHEN dist IS NULL THEN led.caller ELSE array_to_string(p, '>') END || '>' || led.callee AS path,
  CASE WHEN dist IS NOT NULL THEN edges || CASE WHEN g.w IS NOT NULL THEN '|at ' || led.caller || ' ' || led.callee || '/threading_synthetic/thread_start/' || g.w ELSE '' END
       WHEN known THEN 'at ' || led.caller || ' ' || led.callee ELSE '' END AS edges, coalesce(n, 0) AS n_guards, first_guard, last_guard
FROM led LEFT JOIN g ON g.caller = led.caller AND g.callee = led.callee LEFT JOIN along ON along.caller = led.caller LEFT JOIN guards ON guards.caller = led.caller""",
}
