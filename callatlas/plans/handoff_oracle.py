"""DuckDB SQL for the queries of handoff_queries: the faults that each document was given, and coverage, from the raw tables."""

from __future__ import annotations

from .oracle import SQL

_CALLS = """lines AS (
  SELECT 'c' || o_custkey AS seed_id, l_orderkey || '-' || l_linenumber AS unit_id, (l_returnflag <> 'R' OR l_linenumber > 2) AND NOT (l_returnflag = 'N' AND l_linenumber >= 6) AS claimed,
    l_linestatus = 'O' AND l_quantity > 25 AS asked, l_quantity > 30 AS found, l_linestatus = 'O' AND l_quantity > 40 AS open_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
units AS (
  SELECT seed_id, unit_id, bool_or(claimed) AS claimed, bool_or(asked) AS asked, bool_or(found) AS found, count(*) AS n_rows, count(*) FILTER (asked) AS n_asked, count(*) FILTER (open_) AS n_open FROM lines GROUP BY seed_id, unit_id)"""

SQL |= {
    "hand_off_schemas": """WITH told AS (
  SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'A') - 1 AS k, l_partkey, l_returnflag, l_linenumber * 3 AS share FROM lineitem),
faults AS (
  SELECT o_orderkey, k, 1 AS n, 'claims.' || k || '.interpretation: ''part ' || l_partkey || ''' is too short' AS e FROM told WHERE length('part ' || l_partkey) < 10
  UNION ALL SELECT o_orderkey, k, 2, 'claims.' || k || '.source_unit_ids: [] is too short' FROM told WHERE l_returnflag = 'A'
  UNION ALL SELECT o_orderkey, k, 3, 'claims.' || k || '.confidence: ' || (share // 10) || '.' || (share % 10) || ' is greater than the maximum of 1' FROM told WHERE share > 10),
of_lines AS (SELECT o_orderkey, string_agg(e, '; ' ORDER BY k, n) AS errors FROM faults GROUP BY o_orderkey),
judged AS (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'structure' ELSE 'behaviour' END AS kind,
    CASE o_orderkey % 3
      WHEN 0 THEN concat_ws('; ', CASE WHEN o_orderkey % 5 = 0 THEN '''confidence'' is a required property' END,
                                  CASE WHEN o_orderstatus <> 'F' THEN 'claim_type: ''' || o_orderstatus || ''' is not one of [''effect'', ''constraint'', ''input'']' END)
      WHEN 1 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'no JSON' WHEN o_orderkey % 4 = 1 THEN 'seed_id: ' || o_orderkey || ' is not of type ''string''' ELSE '' END
      ELSE coalesce(errors, '') END AS errors
  FROM orders LEFT JOIN of_lines USING (o_orderkey))
SELECT o_orderkey, kind, errors = '' AS ok, errors FROM judged""",
    "claim_coverage": f"""WITH {_CALLS},
n AS (
  SELECT seed_id, CAST(sum(n_rows) AS BIGINT) AS n_calls, count(*) FILTER (claimed) AS n_claimed, count(*) FILTER (NOT claimed) AS n_not, count(*) FILTER (asked) AS n_ambiguous, count(*) FILTER (asked AND found) AS n_looked_up, sum(n_open) AS n_open, sum(n_asked) AS n_asked
  FROM units GROUP BY seed_id),
r AS (SELECT *, CASE WHEN n_asked > 0 THEN n_open / n_asked ELSE 0 END AS ratio FROM n)
SELECT seed_id, n_calls, n_claimed, round(n_claimed / (n_claimed + n_not), 9) AS coverage, n_ambiguous, n_looked_up, round(ratio, 9) AS unresolved_ratio,
  CASE WHEN n_not / n_calls > 0.5 THEN 'failed' WHEN n_not > 0 THEN 'partial' WHEN ratio > 0.5 THEN 'failed' WHEN ratio > 0.2 THEN 'partial' ELSE 'ok' END AS status FROM r""",
    "unclaimed_calls": f"WITH {_CALLS} SELECT seed_id, unit_id FROM units WHERE NOT claimed",
}
