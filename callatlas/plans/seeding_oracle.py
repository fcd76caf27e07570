"""DuckDB SQL for the query of seeding_queries."""

from __future__ import annotations

from .oracle import SQL

_NAME = "'m' || ({0} % 4) || CASE WHEN {0} % 4 > 0 THEN 'xx' ELSE '' END"

SQL["seed_chain"] = f"""WITH c AS (
  SELECT '<tpch.' || lower(p_type) || '.P' || (p_partkey % 100) || ': void ' || {_NAME.format('p_partkey')} || '(int)>' AS signature, arg_max(p_type, p_partkey) AS category, max(p_partkey % 4) AS k FROM part WHERE p_partkey % 100 < 40 GROUP BY 1),
calls AS (
  SELECT o_custkey, category, '<tpch.n1.S' || l_suppkey || ': void run()>' AS caller
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    JOIN c ON signature = '<tpch.' || lower(p_type) || '.P' || (l_partkey % 100) || ': void ' || {_NAME.format('l_partkey')} || '(int)>' WHERE l_linestatus = 'F' AND l_quantity > 45),
files AS (SELECT o_custkey, o_orderkey % 4 AS k, o_orderkey, o_orderstatus = 'O' AS remote, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4, o_orderstatus = 'O' ORDER BY o_orderkey) AS n FROM orders),
searched AS (SELECT o_custkey, category, o_orderkey || '.java' AS caller, remote FROM files JOIN c USING (k) WHERE n <= 10 AND k > 0),
every AS (
  SELECT o_custkey, category, caller, 0 AS p FROM calls UNION ALL SELECT o_custkey, category, caller, CASE WHEN remote THEN 1 ELSE 2 END FROM searched),
best AS (SELECT *, min(p) OVER (PARTITION BY o_custkey) AS b FROM every)
SELECT CAST(o_custkey AS VARCHAR) AS analysis_id, ['calls', 'remote', 'local'][p + 1] AS source, category, CAST([1.0, 0.4, 0.3][p + 1] AS DOUBLE) AS confidence, count(*) AS n, count(DISTINCT caller) AS callers
FROM best WHERE p = b GROUP BY o_custkey, p, category"""
