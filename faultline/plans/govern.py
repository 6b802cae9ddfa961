"""Queries of schema versions, consent, audit and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from faultline.operators import governance as G, schemas as S
from faultline.plans.common import TEL, Query, r
from faultline.plans.streams import _place
from faultline.sources import readers
from faultline.sources.tables import table, telemetry

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


_VER = """CASE event_id % 7 WHEN 0 THEN to_json(named_struct('id', CAST(event_id AS STRING), 'timestamp', 1, 'function', event_type, 'phase', 'exec', 'data', named_struct('x', 1)))
  WHEN 1 THEN to_json(named_struct('record_id', CAST(event_id AS STRING), 'timestamp', 1.5D, 'function_name', event_type, 'execution_phase', 'execution', 'anomaly_type', 'benign', 'telemetry_data', named_struct('x', 1)))
  WHEN 2 THEN to_json(named_struct('record_id', CAST(event_id AS STRING), 'timestamp', 1, 'schema_version', 'v2.1'))
  WHEN 3 THEN to_json(named_struct('id', 'a', 'version', '1.0')) WHEN 4 THEN to_json(named_struct('id', CAST(event_id AS STRING), 'timestamp', 1))
  WHEN 5 THEN to_json(named_struct('id', 1, 'timestamp', 'x', 'function', 2, 'phase', 3, 'data', 4)) ELSE to_json(named_struct('id', 1, 'timestamp', 1, 'function', event_type, 'phase', 3, 'data', named_struct('x', 1))) END"""


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'v1.0' WHEN 1 THEN 'v2.0' WHEN 2 THEN 'v2.1' WHEN 3 THEN 'v1.0' WHEN 6 THEN 'v1.0' END AS schema_version,
  CASE event_id % 7 WHEN 0 THEN 0.9 WHEN 1 THEN round(0.6 * 6 / 7 + 0.4, 6) WHEN 5 THEN 0.5 WHEN 6 THEN 0.74 ELSE 0.0 END::DOUBLE AS match FROM events""")
def detect_schema_version(spark, sf_dir):
    return S.detect_version(table(spark, sf_dir, "events").select("event_id", F.expr(_VER).alias("raw"))).select("event_id", "schema_version", r("match").alias("match"))


@query("""WITH h AS (SELECT event_id, event_type, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('e' || event_id)) AS h FROM events)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS record_id,
  event_type AS function_name, CASE event_id % 5 WHEN 0 THEN 'initialization' WHEN 1 THEN 'execution' WHEN 2 THEN 'completion' WHEN 3 THEN 'error' ELSE 'execution' END AS execution_phase,
  0.3::DOUBLE AS anomaly_confidence, 9.0::DOUBLE AS risk_score, 'v2.2' AS schema_version FROM h""")
def migrate_schema(spark, sf_dir):
    v1 = table(spark, sf_dir, "events").select(F.expr("concat('e', event_id) AS id"), F.lit(1.0).alias("timestamp"), F.col("event_type").alias("function"),
                                               F.expr("element_at(array('init', 'exec', 'complete', 'error', 'other'), CAST(event_id % 5 + 1 AS INT)) AS phase"), F.col("props").alias("data"))
    return S.migrate(v1, "v1.0", "v2.2").select("record_id", "function_name", "execution_phase", "anomaly_confidence", "risk_score", "schema_version")


@query("SELECT event_id, try_cast(event_type AS BIGINT) AS event_type, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value, NULL::VARCHAR AS missing FROM events")
def coerce_and_project(spark, sf_dir):
    target = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("missing", T.StringType())])
    return S.coerce(table(spark, sf_dir, "events"), target)


@query("""SELECT 'flag' AS key, 'boolean' AS kind, count(*) FILTER (WHERE event_id % 3 = 0) AS records, 'ADD_FIELD' AS action FROM events UNION ALL SELECT 'v', 'number', count(*), 'WIDEN_TYPE' FROM events""")
def evolve_schema(spark, sf_dir):
    raw = F.expr("to_json(named_struct('event_id', event_id, 'v', CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) + 0.5D ELSE NULL END, 'w', event_type, 'flag', CASE WHEN event_id % 3 = 0 THEN true END))")
    raw = F.when(F.col("event_id") % 2 == 1, F.expr("to_json(named_struct('event_id', event_id, 'v', event_id, 'w', event_type, 'flag', CASE WHEN event_id % 3 = 0 THEN true END))")).otherwise(raw)
    out = S.evolve(S.profile_keys(table(spark, sf_dir, "events").select(raw.alias("raw"))), {"event_id": "integer", "v": "integer", "w": "string"})
    return out.select("key", "kind", "records", "action")


@query("""WITH c AS (SELECT o_custkey, arg_max(CASE o_orderpriority WHEN '1-URGENT' THEN 'withdrawn' WHEN '2-HIGH' THEN 'denied' ELSE 'granted' END, (o_orderdate, CASE o_orderpriority WHEN '1-URGENT' THEN 'withdrawn' WHEN '2-HIGH' THEN 'denied' ELSE 'granted' END)) AS s, max(o_orderdate) AS d FROM orders WHERE epoch_us(o_orderdate) <= 900000000000000 GROUP BY 1),
e AS (SELECT c_custkey, c_name, CASE WHEN s = 'withdrawn' THEN s WHEN epoch_us(d) + 31536000000000 < 900000000000000 THEN 'unknown' ELSE coalesce(s, 'unknown') END AS consent FROM customer LEFT JOIN c ON o_custkey = c_custkey)
SELECT c_custkey AS subject, consent, consent <> 'granted' AS violation, CASE WHEN consent <> 'granted' THEN c_name ELSE '[REDACTED]' END AS c_name FROM e""")
def apply_consent(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), F.lit("p").alias("policy"), F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS granted_at"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'withdrawn' WHEN '2-HIGH' THEN 'denied' ELSE 'granted' END AS status"), F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) + 31536000000000 AS expires_at"))
    rec = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), "c_name")
    return G.apply_consent(rec, G.latest_consent(log, 900_000_000_000_000), {"c_name": F.lit("[REDACTED]")}, "p").select("subject", "consent", "violation", "c_name")


_AUD = f"""WITH {TEL}, a AS (SELECT CASE anomaly_type WHEN 'execution_failure' THEN 'error' WHEN 'timeout_fallback' THEN 'warning' ELSE 'info' END AS level, CASE WHEN anomaly_type = 'data_exfiltration' THEN 'security' WHEN cpu_utilization > 90 THEN 'compliance' ELSE 'processing' END AS category,
  execution_phase AS action, function_id AS component, duration, ts_us FROM tel)
"""


def _audit(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        F.expr("CASE anomaly_type WHEN 'execution_failure' THEN 'error' WHEN 'timeout_fallback' THEN 'warning' ELSE 'info' END AS level"),
        F.expr("CASE WHEN anomaly_type = 'data_exfiltration' THEN 'security' WHEN cpu_utilization > 90 THEN 'compliance' ELSE 'processing' END AS category"),
        F.col("execution_phase").alias("action"), F.col("function_id").alias("component"), "duration", "ts_us")


@query(_AUD + "SELECT 'level' AS kind, level AS name, count(*) AS n FROM a GROUP BY level UNION ALL SELECT 'category', category, count(*) FROM a GROUP BY category UNION ALL SELECT 'action', action, count(*) FROM a GROUP BY action UNION ALL SELECT 'component', component, count(*) FROM a GROUP BY component")
def audit_summary(spark, sf_dir):
    return G.audit_summary(_audit(spark, sf_dir))


@query(_AUD + "SELECT count(*) AS events, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE category = 'security') AS security, count(*) FILTER (WHERE category = 'compliance') AS compliance, round(avg(duration), 6) AS mean_duration FROM a")
def audit_totals(spark, sf_dir):
    return G.audit_totals(G.audit_filter(_audit(spark, sf_dir), since=0)).withColumn("mean_duration", r("mean_duration"))


@query(f"WITH {TEL} SELECT function_id, count(*) AS n, round(sum(duration), 4) AS total FROM tel GROUP BY 1")
def trace_round_trip(spark, sf_dir):
    """Traces written by dataset and bucket, read back."""
    at = _place(spark)
    readers.write_traces(telemetry(spark, sf_dir).withColumnsRenamed({"function_id": "trace_id"}).withColumn("dataset", F.lit("d")), f"{at}/traces")
    return readers.read_traces(spark, f"{at}/traces", "d").groupBy(F.col("trace_id").alias("function_id")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("duration"), 4).alias("total"))


@query(f"WITH {TEL} SELECT anomaly_type <> 'benign' AS label, count(*) AS n, CAST(sum(memory_spike_kb) AS BIGINT) AS memory FROM tel GROUP BY 1")
def labelled_json_round_trip(spark, sf_dir):
    """Records written as gzipped JSON and read back with their labels."""
    at = _place(spark)
    t = telemetry(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string"))
    t.write.option("compression", "gzip").json(f"{at}/labelled")
    df = spark.read.schema(readers.TELEMETRY_SCHEMA).json(f"{at}/labelled").withColumn("label", F.col("anomaly_type") != "benign")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("memory_spike_kb").alias("memory"))
