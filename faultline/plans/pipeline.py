"""Queries of the record projections and the canonical layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import layers, records, validation
from faultline.plans.common import SCORED, TEL, Query, r
from faultline.sources.tables import scored_telemetry, telemetry

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AT = "2024-01-02T00:00:00+00:00"


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query(f"""WITH {SCORED}, k AS (SELECT *, least(1.0, 0.3 * severity / 10 + 0.25 * adversarial_score + 0.2 * economic_risk_score
    + 0.15 * silent_failure_probability + 0.1 * (1 - confidence_level)) AS risk FROM sc)
SELECT event_id, severity, category, round(risk, 6) AS risk, severity >= 8 OR risk >= 0.8 OR category IN ('security','silent_failure') AS critical,
  CASE WHEN severity >= 8 OR risk >= 0.8 OR category IN ('security','silent_failure') THEN 10 WHEN fallback_mode THEN 8
    WHEN anomaly_type <> 'benign' THEN 6 ELSE 3 END AS priority FROM k""")
def record_risk(spark, sf_dir):
    return records.risk_columns(scored_telemetry(spark, sf_dir)).select("event_id", "severity", "category", r("risk").alias("risk"), "critical", "priority")


@query(f"""WITH {SCORED}, k AS (SELECT *, severity >= 8 OR category IN ('security','silent_failure')
    OR 0.3 * severity / 10 + 0.25 * adversarial_score + 0.2 * economic_risk_score + 0.15 * silent_failure_probability + 0.1 * (1 - confidence_level) >= 0.8 AS crit FROM sc)
SELECT CASE WHEN crit THEN 10 WHEN fallback_mode THEN 8 WHEN anomaly_type <> 'benign' THEN 6 ELSE 3 END AS priority,
  count(*) AS n, count(DISTINCT function_id) AS functions FROM k GROUP BY 1""")
def route_by_priority(spark, sf_dir):
    return records.risk_columns(scored_telemetry(spark, sf_dir)).groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("function_id").alias("functions"))


@query(f"""WITH {TEL}, m AS (UNPIVOT (SELECT duration, CAST(memory_spike_kb AS DOUBLE) AS memory_spike_kb, cpu_utilization,
    CAST(network_io_bytes AS DOUBLE) AS network_io_bytes FROM tel) ON duration, memory_spike_kb, cpu_utilization, network_io_bytes INTO NAME metric VALUE v)
SELECT metric, count(*) AS n, round(sum(v), 3) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high FROM m GROUP BY metric""")
def emit_metrics(spark, sf_dir):
    out = records.emit_metrics(telemetry(spark, sf_dir), ["duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes"])
    return out.select("metric", "n", r("total", 3).alias("total"), r("low").alias("low"), r("high").alias("high"))


_RAW = """to_json(struct(CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS STRING) END AS event_id, concat('p', event_id) AS payload_id,
    unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 AS invocation_timestamp, concat('fn_', user_id % 20) AS function_profile_id,
    upper(CASE event_type WHEN 'signup' THEN 'initialization' WHEN 'purchase' THEN 'completion' WHEN 'error' THEN 'error' ELSE 'other' END) AS phase,
    CASE WHEN event_type = 'error' THEN 'Execution_Failure' WHEN event_id % 5 = 0 THEN 'starvation' ELSE 'benign' END AS anomaly,
    named_struct('duration_ms', value * 100, 'max_memory_used_mb', event_id % 512) AS telemetry_fields,
    CASE WHEN event_id % 2 = 0 THEN event_id % 97 END AS cpu, event_id % 7 AS network_calls, event_id % 13 = 0 AS force_starvation,
    named_struct('region', concat('r', event_id % 3)) AS execution_environment)) AS raw"""


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'p' || event_id ELSE CAST(event_id AS VARCHAR) END AS event_id,
  'fn_' || (user_id % 20) AS function_id, round(epoch_us(ts) / 1000000, 3) AS timestamp,
  CASE event_type WHEN 'signup' THEN 'init' WHEN 'purchase' THEN 'shutdown' WHEN 'error' THEN 'error' ELSE 'invoke' END AS execution_phase,
  CASE WHEN event_type = 'error' THEN 'execution_failure' ELSE 'benign' END AS anomaly_type, round(value / 10, 6) AS duration,
  event_id % 512 * 1024 AS memory_spike_kb,
  CAST(coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN event_id % 97 END, 0), CASE WHEN event_type = 'error' THEN 88 ELSE 26 END) AS DOUBLE) AS cpu_utilization,
  event_id % 7 * 1024 AS network_io_bytes, event_id % 13 = 0 AS fallback_mode, 'r' || (event_id % 3) AS region FROM events""")
def normalise_event(spark, sf_dir):
    from faultline.sources.tables import table
    out = records.normalise_event(table(spark, sf_dir, "events").select(F.expr(_RAW)))
    return out.select("event_id", "function_id", r("timestamp", 3).alias("timestamp"), "execution_phase", "anomaly_type", r("duration").alias("duration"),
                      "memory_spike_kb", "cpu_utilization", "network_io_bytes", "fallback_mode", "region")


@query(f"""WITH {SCORED} SELECT event_id, substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS record_id,
  function_id AS function_name, label, phase, round(ts_us / 1000000, 6) AS timestamp,
  CASE WHEN phase = 'error' THEN 'L0 execution error - anomaly: ' || anomaly_type END AS error_message, severity AS anomaly_severity
FROM (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS h FROM sc)""")
def adapt_to_intake(spark, sf_dir):
    out = records.adapt(scored_telemetry(spark, sf_dir), AT)
    return out.select("event_id", "record_id", "function_name", "label", "phase", r("timestamp").alias("timestamp"), "error_message",
                      F.col("context_metadata.anomaly_severity").alias("anomaly_severity"))


_INTAKE = f"""WITH {SCORED},
i AS (SELECT *, round(CAST(1 - 0.15 AS DOUBLE) - CASE WHEN trigger_type IS NOT NULL THEN 0.1 ELSE 0 END, 4) AS preservation FROM sc),
j AS (SELECT *, round(greatest(0.1, least(1, confidence_level * preservation)), 4) AS trust_score FROM i)"""


@query(_INTAKE + """ SELECT event_id, preservation, trust_score, 1.0::DOUBLE AS completeness, 'telemetry_data.layer0_metrics.l0_processing_timestamp' AS redacted,
  'preservation_below_target' AS issues, CASE WHEN trigger_type IS NULL THEN NULL ELSE sha256(trigger_type) END AS trigger_hash,
  sha1(record_id || '|' || function_id || '|' || printf('%.6f', ts_us / 1000000)) AS trace_id
FROM (SELECT *, substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS record_id
      FROM (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS h FROM j))""")
def intake(spark, sf_dir):
    good, _ = layers.split_valid(layers.intake(records.adapt(scored_telemetry(spark, sf_dir), AT)))
    return good.select("event_id", "preservation", "trust_score", "completeness", F.concat_ws(",", "redacted_fields").alias("redacted"),
                       F.concat_ws(",", "issues").alias("issues"), F.col("context_metadata.trigger_type").alias("trigger_hash"), "trace_id")


_L2 = _INTAKE + """,
g AS (SELECT *, 0::DOUBLE + CASE WHEN duration >= 1 THEN 0.2 ELSE 0 END + CASE WHEN memory_spike_kb >= 131072 THEN 0.3 ELSE 0 END
    + CASE WHEN cpu_utilization >= 80 THEN 0.25 ELSE 0 END + CASE WHEN network_io_bytes >= 4096 THEN 0.15 ELSE 0 END AS s1,
  economic_risk_score * 0.25 + silent_failure_probability * 0.25 + (1 - completeness_score) * 0.15 AS s2,
  least(1, parents / 8.0 + least(0.25, causal_depth * 0.05::DOUBLE)) AS s3,
  0::DOUBLE + CASE WHEN label <> 'benign' THEN 0.45 ELSE 0 END + CASE WHEN phase IN ('initialization','execution') THEN 0.1 ELSE 0 END
    + CASE WHEN category IN ('security','silent_failure','execution') THEN 0.1 ELSE 0 END + CASE WHEN severity >= 7 THEN 0.1 ELSE 0 END AS s4 FROM j),
d AS (SELECT *, (s1 * 0.7 + s2 * 0.65 + s3 * 0.6 + s4 * 0.75) / 2.7 AS agg,
  (CAST(s1 >= 0.3 AS INT) + CAST(s2 >= 0.3 AS INT) + CAST(s3 >= 0.3 AS INT) + CAST(s4 >= 0.3 AS INT)) / 4 AS cons FROM g),
"""


@query(_L2.rstrip().rstrip(",") + """ SELECT event_id, round(s1, 6) AS rule_chain, round(s2, 6) AS drift_tracker, round(s3, 6) AS graph_immunized, round(s4, 6) AS semantic_deviation,
  round(CAST(agg::VARCHAR AS DECIMAL(24, 18)), 4)::DOUBLE AS aggregate_score, agg >= 0.3 AS anomaly_indicated, cons AS detector_consensus FROM d""")
def detection_matrix(spark, sf_dir):
    good, _ = layers.split_valid(layers.intake(records.adapt(scored_telemetry(spark, sf_dir), AT)))
    out = layers.detection_matrix(good)
    return out.select("event_id", *[r(c).alias(c) for c in ("rule_chain", "drift_tracker", "graph_immunized", "semantic_deviation", "aggregate_score")],
                      "anomaly_indicated", "detector_consensus")


_L3 = _L2 + """e AS (SELECT *, greatest(0.1, least(1, (0.8 + trust_score) / 2)) AS eff FROM d),
f AS (SELECT *, greatest(0.1, least(1, eff * 0.7)) AS w1, greatest(0.1, least(1, eff * 0.65)) AS w2, greatest(0.1, least(1, eff * 0.6)) AS w3,
  greatest(0.1, least(1, eff * 0.75)) AS w4 FROM e),
h AS (SELECT *, (s1 * w1 + s2 * w2 + s3 * w3 + s4 * w4) / (w1 + w2 + w3 + w4) AS raw FROM f),
l AS (SELECT *, least(0.15, abs(round(CAST(agg::VARCHAR AS DECIMAL(24, 18)), 4)::DOUBLE - raw)) AS vol FROM h),
o AS (SELECT *, greatest(0, least(1, raw - vol + least(0.1, cons * 0.1))) AS fused FROM l),
p AS (SELECT *, CASE WHEN round(fused, 4) >= 0.75 THEN 'escalate' WHEN round(fused, 4) >= 0.3 THEN 'review' ELSE 'observe' END AS decision,
  CASE WHEN fused >= 0.75 THEN 'high' WHEN fused >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM o)
"""


@query(_L3 + "SELECT event_id, round(CAST(fused::VARCHAR AS DECIMAL(24, 18)), 4)::DOUBLE AS fused_score, band AS risk_band, decision, round(vol, 3) AS volatility FROM p")
def trust_fusion(spark, sf_dir):
    out = layers.run_pipeline(scored_telemetry(spark, sf_dir), AT)
    return out.select("event_id", r("fused_score", 4).alias("fused_score"), "risk_band", "decision", r("volatility_adjustment", 3).alias("volatility"))


@query(_L3 + """SELECT event_id, decision || '-collection' AS campaign_cluster, 0.6::DOUBLE AS alignment_confidence, 'telemetry-observation' AS techniques,
  CASE decision WHEN 'escalate' THEN 'immediate_containment_review' WHEN 'review' THEN 'analyst_triage' ELSE 'monitor' END AS recommended_action,
  'payload_hash,content_hash' AS redacted, 4::INT AS points FROM p""")
def decision_trace_verbose(spark, sf_dir):
    out = layers.run_pipeline(scored_telemetry(spark, sf_dir), AT, verbosity="verbose", redaction_budget=2)
    return out.select("event_id", "campaign_cluster", "alignment_confidence", F.concat_ws(",", "techniques").alias("techniques"), "recommended_action",
                      F.concat_ws(",", "trace_redacted").alias("redacted"), F.size("explanation_points").alias("points"))


@query(_L3 + """SELECT decision, CASE WHEN anomaly_type LIKE '%timeout%' THEN 'impact' WHEN anomaly_type LIKE '%exfil%' THEN 'exfiltration'
    WHEN anomaly_type LIKE '%spike%' THEN 'discovery' ELSE 'collection' END AS tactic, count(*) AS n, round(avg(fused), 4) AS mean_score FROM p GROUP BY 1, 2""")
def threat_alignment(spark, sf_dir):
    out = layers.run_pipeline(scored_telemetry(spark, sf_dir), AT, label="anomaly_type")
    return out.select("decision", F.explode("tactics").alias("tactic"), "fused_score").groupBy("decision", "tactic").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("fused_score"), 4).alias("mean_score"))


_TRUST = _L3.replace("WITH tel", "WITH RECURSIVE tel", 1).rstrip() + """,
v AS (SELECT event_id, function_id, CASE WHEN anomaly_type LIKE '%timeout%' THEN 1 ELSE 0 END AS imp,
  CASE WHEN label <> 'benign' THEN 0.05 ELSE -0.05 END + CASE WHEN anomaly_type LIKE '%timeout%' THEN 0.02 ELSE 0 END AS delta,
  row_number() OVER (PARTITION BY function_id ORDER BY ts_us, event_id) AS rn FROM p),
w AS (SELECT function_id, 0::BIGINT AS rn, 0.8::DOUBLE AS t, NULL::BIGINT AS event_id, 0 AS imp FROM (SELECT DISTINCT function_id FROM v)
  UNION ALL SELECT v.function_id, v.rn, greatest(0.1, least(1.0, w.t + v.delta)), v.event_id, v.imp FROM w JOIN v ON v.function_id = w.function_id AND v.rn = w.rn + 1)
SELECT event_id, round(t, 4) AS adjusted_trust, rn AS replay_queue_size, CASE WHEN imp = 1 OR t >= 0.85 THEN 'high' WHEN t >= 0.6 THEN 'medium' ELSE 'low' END AS replay_priority
FROM w WHERE rn > 0"""


def _with_verdict(spark, sf_dir):
    out = layers.run_pipeline(scored_telemetry(spark, sf_dir), AT, label="anomaly_type")
    return out.withColumn("verdict", F.when(F.col("label") != "benign", "confirmed").otherwise("false_positive"))


@query(_TRUST)
def feedback_trust(spark, sf_dir):
    out = layers.feedback_trust(_with_verdict(spark, sf_dir).select("event_id", "function_id", "ts_us", "tactics", "alignment_confidence", "verdict"), "verdict")
    return out.select("event_id", r("adjusted_trust", 4).alias("adjusted_trust"), "replay_queue_size", "replay_priority")


@query(f"""WITH {SCORED} SELECT field, message, count(*) AS n FROM (
  SELECT 'telemetry_data.l0_cpu_utilization' AS field, 'must be <= 100' AS message FROM sc WHERE cpu_utilization * 1.5 > 100
  UNION ALL SELECT 'telemetry_data.l0_duration_ms', 'must be >= 0' FROM sc WHERE duration - 1 < 0
  UNION ALL SELECT 'context_metadata.economic_risk_score', 'must be <= 1' FROM sc WHERE economic_risk_score * 4 > 1) GROUP BY 1, 2""")
def validate_intake(spark, sf_dir):
    t = scored_telemetry(spark, sf_dir).withColumns({"cpu_utilization": F.col("cpu_utilization") * 1.5, "duration": F.col("duration") - 1,
                                                     "economic_risk_score": F.col("economic_risk_score") * 4})
    out = validation.validate_intake(records.adapt(t, AT))
    return out.select(F.inline("errors")).groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORED} SELECT event_id, CAST(1 + CASE WHEN execution_phase = 'init' AND duration * 20 > 60 THEN 1 ELSE 0 END
   + CASE WHEN duration * 20 > 900 THEN 1 ELSE 0 END + CASE WHEN ts_us > 21600000000 THEN 1 ELSE 0 END AS INT) AS n_warnings,
   event_id % 100 <> 0 AS valid,
   round(1::DOUBLE - CASE WHEN event_id % 100 = 0 THEN 0.3 ELSE 0 END - 0.05 * (1 + CASE WHEN execution_phase = 'init' AND duration * 20 > 60 THEN 1 ELSE 0 END
   + CASE WHEN duration * 20 > 900 THEN 1 ELSE 0 END + CASE WHEN ts_us > 21600000000 THEN 1 ELSE 0 END), 6) AS quality_score FROM sc""")
def validate_telemetry(spark, sf_dir):
    t = scored_telemetry(spark, sf_dir).withColumns({"duration": F.col("duration") * 20, "timestamp": F.col("ts_us") / 1_000_000,
                                                     "source": F.when(F.col("event_id") % 100 == 0, "").otherwise("primary")})
    return validation.validate_telemetry(t, 21600.0).select("event_id", F.size("warnings").alias("n_warnings"), "valid", r("quality_score").alias("quality_score"))


_CONTRACT = {"fields": {
    "event_id": {"required": True}, "duration": {"required": True, "min": 0.5, "max": 20},
    "execution_phase": {"enum": ["init", "invoke", "error"]}, "cpu_utilization": {"max": 95.0}, "function_id": {"type": "bigint"},
    "ts_us": {}, "anomaly_type": {}, "memory_spike_kb": {}}, "additional": False}


@query(f"""WITH {TEL} SELECT field, violation, count(*) AS n FROM (
  SELECT 'duration' AS field, 'below_minimum' AS violation FROM tel WHERE duration < 0.5
  UNION ALL SELECT 'duration', 'above_maximum' FROM tel WHERE duration > 20
  UNION ALL SELECT 'execution_phase', 'not_in_enum' FROM tel WHERE execution_phase NOT IN ('init','invoke','error')
  UNION ALL SELECT 'cpu_utilization', 'above_maximum' FROM tel WHERE cpu_utilization > 95
  UNION ALL SELECT 'function_id', 'type_mismatch' FROM tel UNION ALL SELECT 'network_io_bytes', 'additional_property' FROM tel) GROUP BY 1, 2""")
def validate_contract(spark, sf_dir):
    return validation.violation_counts(validation.validate_contract(telemetry(spark, sf_dir), _CONTRACT))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT (n_chars BETWEEN 100 AND 5000) THEN 'n_chars:range' END, CASE WHEN lang NOT IN ('en','fr') THEN 'lang:enum' END,
  CASE WHEN NOT regexp_matches(source, '^[a-z]+$') THEN 'source:pattern' END, CASE WHEN length(text) > 20000 THEN 'text:length' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents""")
def validate_rules(spark, sf_dir):
    from faultline.sources.tables import table
    rules = [{"field": "n_chars", "kind": "range", "min": 100, "max": 5000}, {"field": "lang", "kind": "enum", "values": ["en", "fr"]},
             {"field": "source", "kind": "pattern", "pattern": "^[a-z]+$"}, {"field": "text", "kind": "length", "max": 20000}]
    return validation.validate_rules(table(spark, sf_dir, "documents"), rules).select("doc_id", F.concat_ws(",", "failed_rules").alias("failed"))


@query(f"""WITH {TEL}, m AS (SELECT function_id, (CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) AS miss FROM tel)
SELECT function_id, round(avg(1 - miss / 9.0), 6) AS overall, avg(1 - miss / 9.0) >= 0.8 AS verified, count(*) FILTER (WHERE miss > 0) AS incomplete FROM m GROUP BY 1""")
def completeness_score(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumns({"duration": F.when(F.col("event_id") % 4 != 0, F.col("duration")),
                                              "cpu_utilization": F.when(F.col("event_id") % 6 != 0, F.col("cpu_utilization"))})
    fields = ["event_id", "ts_us", "function_id", "execution_phase", "anomaly_type", "duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes"]
    return validation.completeness(t, fields).groupBy("function_id").agg(
        r(F.avg("completeness")).alias("overall"), (F.avg("completeness") >= 0.8).alias("verified"), F.count_if(F.size("missing_fields") > 0).alias("incomplete"))


@query(_L3 + """SELECT event_id, function_id, round(fused, 4) AS fused_score FROM p WHERE decision = 'review' AND anomaly_type LIKE '%timeout%' AND ts_us >= 3600000000
  AND event_id % 9 <> 0""")
def filter_detections(spark, sf_dir):
    out = layers.run_pipeline(scored_telemetry(spark, sf_dir), AT, label="anomaly_type")
    links = telemetry(spark, sf_dir).where("event_id % 9 = 0").select("event_id", F.lit("open").alias("status"))
    out = validation.filter_detections(out, decision="review", technique="service-degradation", since=3_600_000_000, case_links=links, case_status="none")
    return out.select("event_id", "function_id", r("fused_score", 4).alias("fused_score"))


@query(f"""WITH {TEL} SELECT event_id, duration, memory_spike_kb, cpu_utilization, network_io_bytes, CAST(execution_phase = 'init' AS INT) AS is_cold_start, CAST(execution_phase = 'error' AS INT) AS error_occurred,
  round(ts_us / 1000000 % 86400 / 3600, 6) AS hour_of_day, CAST(floor(ts_us / 1000000 / 86400) % 7 AS BIGINT) AS day_of_week, round(memory_spike_kb / 1024.0, 6) AS memory_mb, CAST(execution_phase = 'invoke' AS INT) AS execution_phase_invoke, 0 AS source_primary FROM tel""")
def time_features(spark, sf_dir):
    out = records.time_features(telemetry(spark, sf_dir))
    return out.withColumns({"memory_mb": r("memory_mb"), "hour_of_day": r("hour_of_day"), "day_of_week": F.col("day_of_week").cast("long")})


@query("""SELECT c_custkey AS id, upper(c_name) AS label, round(c_acctbal, 2) AS balance, coalesce(CAST(NULL AS VARCHAR), c_mktsegment) AS segment,
  substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS tag, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state FROM customer""")
def map_fields(spark, sf_dir):
    from faultline.sources.tables import table
    spec = {"id": {"source": "c_custkey", "required": True}, "label": {"source": "c_name", "transform": records.TRANSFORMS["to_uppercase"]},
            "balance": {"source": "c_acctbal", "transform": "round({}, 2)"}, "segment": {"source": "c_mktsegment", "default": "none"},
            "tag": {"source": "c_custkey", "transform": "substring(sha2(CAST({} AS STRING), 256), 1, 8)"},
            "state": {"expr": "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END"}}
    return records.map_fields(table(spark, sf_dir, "customer"), spec, keep_unknown=False).drop("mapping_errors")


@query(f"""WITH {SCORED} SELECT event_id, label AS "context_metadata.anomaly_normalised_to", duration AS "telemetry_data.l0_duration_ms", anomaly_type AS "telemetry_data.layer0_metrics.l0_original_anomaly_type" FROM sc""")
def flatten_record(spark, sf_dir):
    flat = records.flatten(records.adapt(scored_telemetry(spark, sf_dir)).select("event_id", "telemetry_data", "context_metadata"))
    return flat.select("event_id", "`telemetry_data.l0_duration_ms`", "`telemetry_data.layer0_metrics.l0_original_anomaly_type`", "`context_metadata.anomaly_normalised_to`")


@query("""SELECT event_id, substr(regexp_replace(coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN props END), ''), event_type || '#' || event_id), '[^a-zA-Z0-9\\-_]', '', 'g'), 1, 100) AS correlation_id FROM events""")
def correlation_id(spark, sf_dir):
    from faultline.sources.tables import table
    t = table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN props END AS a"), F.expr("concat(event_type, '#', event_id) AS b"))
    return t.select("event_id", records.correlation_id("a", "b").alias("correlation_id"))


@query("""SELECT c_custkey AS id, lower(c_name) AS to_lowercase, upper(c_name) AS to_uppercase, upper(c_name[1]) || lower(c_name[2:]) AS capitalize, substr(md5(c_name), 1, 16) AS hash_value, c_name[1:2] || repeat('*', length(c_name) - 2) AS anonymize,
  lower(trim(c_name)) AS normalize, round_even(c_acctbal, 0)::DOUBLE AS round, abs(c_acctbal)::DOUBLE AS abs, round(sqrt(c_custkey), 9) AS sqrt, trunc(c_acctbal)::BIGINT AS to_int, c_custkey::VARCHAR AS to_string, c_acctbal <> 0 AS to_bool,
  strftime(make_timestamp(c_custkey * 1000000000), '%Y-%m-%dT%H:%M:%S+00:00') AS from_timestamp, strftime(make_timestamp(c_custkey * 1000000000), '%Y-%m-%d') AS format_date FROM customer""")
def field_transforms(spark, sf_dir):
    from faultline.sources.tables import table
    t, on = records.TRANSFORMS, {"name": ("to_lowercase", "to_uppercase", "capitalize", "hash_value", "anonymize", "normalize"), "balance": ("round", "abs", "to_int", "to_bool"), "id": ("to_string",), "time": ("from_timestamp", "format_date")}
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "CAST(c_acctbal AS DOUBLE) AS balance", "c_custkey * 1000 AS time")
    return rows.select("id", *[F.expr(t[k].format(c)).alias(k) for c, ks in on.items() for k in ks], r(F.expr(t["sqrt"].format("id")), 9).alias("sqrt"))
