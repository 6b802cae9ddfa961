"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: the telemetry view in SQL, for the checks
TEL = """tel AS (
SELECT event_id, 'fn_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS function_id,
  (epoch_us(ts) - 1704067200000000) // 60 AS ts_us,
  CASE event_type WHEN 'signup' THEN 'init' WHEN 'purchase' THEN 'shutdown' WHEN 'error' THEN 'error' ELSE 'invoke' END AS execution_phase,
  CASE WHEN event_type='error' AND event_id % 3 = 0 THEN 'timeout_fallback' WHEN event_type='error' THEN 'execution_failure'
       WHEN event_id % 17 = 0 THEN 'memory_spike' WHEN event_id % 23 = 0 THEN 'data_exfiltration' ELSE 'benign' END AS anomaly_type,
  value / 10.0 AS duration,
  CAST(json_extract_string(props,'$.k') AS BIGINT) * 2048 AS memory_spike_kb,
  CAST((event_id * 37) % 101 AS DOUBLE) AS cpu_utilization,
  ((event_id * 7919) % 1000) * 65536 AS network_io_bytes
FROM events)"""


def r(col: Column | str, places: int = 6) -> Column:
    """Rounded double, without negative zero."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), places) + F.lit(0.0)


def merge(*dicts: dict) -> dict:
    out: dict = {}
    for d in dicts:
        dup = out.keys() & d.keys()
        if dup:
            raise ValueError(f"duplicate names {dup}")
        out |= d
    return out

#: the scored view in SQL
SCORED = TEL + """,
sc AS (SELECT *, event_id % 11 / 20.0 AS adversarial_score, cpu_utilization / 200 AS economic_risk_score,
  event_id % 10 / 20.0 AS silent_failure_probability, 1 - event_id % 7 / 20.0 AS completeness_score, 1 - event_id % 5 / 20.0 AS confidence_level,
  event_id % 13 = 0 AS fallback_mode, CASE WHEN event_id % 2 = 0 THEN 'http' END AS trigger_type, event_id % 4 AS causal_depth,
  CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS parents,
  CASE anomaly_type WHEN 'timeout_fallback' THEN 5 WHEN 'execution_failure' THEN 6 WHEN 'memory_spike' THEN 3 WHEN 'data_exfiltration' THEN 10 ELSE 0 END AS severity,
  CASE anomaly_type WHEN 'timeout_fallback' THEN 'system' WHEN 'execution_failure' THEN 'execution' WHEN 'memory_spike' THEN 'performance'
    WHEN 'data_exfiltration' THEN 'security' ELSE 'normal' END AS category,
  CASE anomaly_type WHEN 'benign' THEN 'benign' WHEN 'data_exfiltration' THEN 'malicious' ELSE 'suspicious' END AS label,
  CASE execution_phase WHEN 'init' THEN 'initialization' WHEN 'shutdown' THEN 'completion' WHEN 'error' THEN 'error' ELSE 'execution' END AS phase
FROM tel)"""


def gap(x: str, y: str, cols: str = "abcd") -> str:
    """Euclidean distance of two rows in SQL, added up in the order of the columns."""
    return "sqrt(" + " + ".join(f"({x}.{c} - {y}.{c}) * ({x}.{c} - {y}.{c})" for c in cols) + ")"


def dbscan_sql(table: str, cols: str, eps: float, least: int) -> str:
    """Clauses up to z(id, cluster): the density cluster of each row of ``table``, named by its smallest core row; null for noise."""
    return f"""e AS MATERIALIZED (SELECT x.id, y.id AS o FROM {table} x, {table} y WHERE {gap("x", "y", cols)} <= {eps}),
core AS MATERIALIZED (SELECT id FROM e GROUP BY id HAVING count(*) >= {least}),
ce AS MATERIALIZED (SELECT e.id, e.o FROM e JOIN core a ON a.id = e.id JOIN core b ON b.id = e.o WHERE e.id <> e.o),
cc(id, cluster) USING KEY (id) AS (SELECT id, id FROM core UNION
  SELECT ce.o, min(cc.cluster) FROM cc JOIN ce ON ce.id = cc.id JOIN recurring.cc AS old ON old.id = ce.o WHERE cc.cluster < old.cluster GROUP BY ce.o),
z AS (SELECT t.id, coalesce(any_value(cc.cluster), min(b.cluster)) AS cluster FROM {table} t LEFT JOIN cc ON cc.id = t.id LEFT JOIN e ON e.id = t.id LEFT JOIN cc b ON b.id = e.o GROUP BY t.id)"""
