"""DuckDB SQL for the queries of stream_queries: the same results by one batch over the raw tables."""

from __future__ import annotations

from .oracle import SQL

_STAGES = """SELECT CAST(user_id % 8 AS VARCHAR) AS analysis_id, CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, epoch_us(min(ts) FILTER (event_id % 2 = 0)) AS started,
  epoch_us(max(ts) FILTER (event_id % 2 = 1)) AS ended, count(*) AS n_events FROM events GROUP BY user_id, event_type"""

SQL |= {
    "ledger_tail": _STAGES,
    "ledger_stream_available_now": _STAGES,
    "progressive_methods": """WITH u AS (
  SELECT CAST(l_partkey % 2 AS VARCHAR) AS analysis_id, '<tpch.' || lower(split_part(p_type, ' ', 1)) || '.P' || (l_partkey % 100) || ': void call(int)>' AS method, l_partkey % 100 AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 10 <> 3)
SELECT analysis_id, method, count(*) AS usage_count, part % 4 IN (1, 2) AS jadx_available, CASE part % 4 WHEN 0 THEN 'pending' WHEN 3 THEN 'no_jadx' ELSE 'complete' END AS analysis_status,
  CASE WHEN part % 4 IN (1, 2) THEN 'part ' || part END AS function_summary, round(CASE WHEN part % 4 = 0 THEN 0 ELSE part / 100 END, 6) AS confidence
FROM u GROUP BY analysis_id, method, part""",
    "run_list_changes": """WITH s AS (
  SELECT n AS snapshot, user_id, arg_max(event_type, event_id) AS end_status, count(*) AS event_count
  FROM events, range(1, 6) r(n) WHERE event_id * 4 <= (SELECT max(event_id) FROM events) * least(n, 4) AND (n <> 3 OR user_id % 7 <> 0) GROUP BY n, user_id),
pairs AS (
  SELECT coalesce(a.snapshot, b.snapshot + 1) AS snapshot, coalesce(a.user_id, b.user_id) AS user_id, a.end_status, a.event_count, b.end_status AS was, b.event_count AS had, a.user_id IS NULL AS gone, b.user_id IS NULL AS come
  FROM s a FULL JOIN s b ON a.user_id = b.user_id AND a.snapshot = b.snapshot + 1 WHERE coalesce(a.snapshot, b.snapshot + 1) <= 5)
SELECT snapshot, CAST(user_id AS VARCHAR) AS run_id, CASE WHEN gone THEN 'removed' WHEN come THEN 'added' ELSE 'changed' END AS change, end_status, event_count
FROM pairs WHERE gone OR come OR end_status <> was OR event_count <> had""",
}
