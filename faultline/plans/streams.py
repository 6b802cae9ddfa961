"""Queries that run the streaming jobs over the event files to the end (available-now)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from faultline.plans.common import TEL, Query, r
from faultline.plans.detectors import ORACLES as DETECTOR_SQL
from faultline.plans.detectors import fusion
from faultline.sources.tables import EPOCH_US, table, telemetry_of
from faultline.streaming import jobs as J

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _place(spark) -> str:
    """A new folder under the cluster's checkpoint folder; a temporary one only if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/streams/{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-streams-", dir="/tmp")


def _telemetry_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    raw = J.stream_files(spark, f"{sf_dir}/events*.parquet", schema)
    return telemetry_of(raw).withColumn("ts", F.timestamp_micros(F.col("ts_us") + EPOCH_US))


def _finish(spark, df, mode="append"):
    at = _place(spark)
    write = None if mode == "append" else J.overwrite_latest(f"{at}/out")
    q = J.run(df, f"{at}/out", f"{at}/ckpt", mode, write=write)
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


_CLOSED = "(SELECT max(ts_us) FROM tel) - 5000000"


@query(f"""WITH {TEL} SELECT function_id, ts_us // 30000000 * 30000000 AS start_us, count(*) AS n, count(*) FILTER (WHERE anomaly_type <> 'benign') AS anomalies, max(ts_us) AS latest_us FROM tel
GROUP BY 1, 2 HAVING ts_us // 30000000 * 30000000 + 30000000 <= {_CLOSED}""".replace("HAVING ts_us // 30000000 * 30000000", "HAVING any_value(ts_us) // 30000000 * 30000000"))
def stream_tumbling(spark, sf_dir):
    out = _finish(spark, J.tumbling(_telemetry_stream(spark, sf_dir), "function_id"))
    return out.select("function_id", (F.unix_micros("w.start") - EPOCH_US).alias("start_us"), "n", "anomalies", (F.unix_micros("latest") - EPOCH_US).alias("latest_us"))


@query(f"""WITH {TEL}, s AS (SELECT *, unnest([ts_us // 30000000 * 30000000, ts_us // 30000000 * 30000000 - 30000000]) AS st FROM tel) SELECT function_id, st AS start_us, count(*) AS n FROM s GROUP BY 1, 2 HAVING st + 60000000 <= {_CLOSED}""")
def stream_sliding(spark, sf_dir):
    out = _finish(spark, J.sliding(_telemetry_stream(spark, sf_dir), "function_id"))
    return out.select("function_id", (F.unix_micros("w.start") - EPOCH_US).alias("start_us"), "n")


@query(f"""WITH {TEL}, b AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w >= 60000000, true) AS brk FROM tel WINDOW w AS (PARTITION BY function_id ORDER BY ts_us, event_id)), i AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY function_id ORDER BY ts_us, event_id) AS s FROM b)
SELECT function_id, min(ts_us) AS start_us, max(ts_us) + 60000000 AS end_us, count(*) AS n FROM i GROUP BY function_id, s HAVING max(ts_us) + 60000000 <= {_CLOSED}""")
def stream_sessions(spark, sf_dir):
    out = _finish(spark, J.sessions(_telemetry_stream(spark, sf_dir), "function_id"))
    return out.select("function_id", (F.unix_micros("w.start") - EPOCH_US).alias("start_us"), (F.unix_micros("w.end") - EPOCH_US).alias("end_us"), "n")


@query(f"WITH {TEL} SELECT function_id, count(*) AS n, count(*) FILTER (WHERE anomaly_type <> 'benign') AS anomalies, round(sum(duration), 4) AS total_duration FROM tel GROUP BY 1")
def stream_global(spark, sf_dir):
    out = _finish(spark, J.global_totals(_telemetry_stream(spark, sf_dir), "function_id"), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select("function_id", "n", "anomalies", r("total_duration", 4).alias("total_duration"))  # one row


@query("SELECT event_type || '-' || (event_id % 1000) AS content, count(DISTINCT 1) AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    """Content-hash duplicates removed within one long watermark."""
    s = _telemetry_stream(spark, sf_dir)
    raw = J.stream_files(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    s = raw.select(F.concat_ws("-", "event_type", F.expr("CAST(event_id % 1000 AS STRING)")).alias("content"), F.col("ts").cast("timestamp").alias("ts"))
    out = _finish(spark, J.dedup(s, ["content"], within="400 days"))
    return out.groupBy("content").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, min(event_id) AS first_id, count(DISTINCT event_id) > 0 AS kept FROM events GROUP BY 1")
def dedup_batch(spark, sf_dir):
    out = J.dedup_batch(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], ["event_id"])
    return out.select("event_type", F.col("event_id").alias("first_id"), F.lit(True).alias("kept"))


@query(DETECTOR_SQL["fusion_explanation"].replace("name IN ('cold_start','cpu_burst','io_intensive','network_anomaly','resource_spike','storage_anomaly','timeout_pattern')", "name IN ('io_intensive','resource_spike','storage_anomaly')").replace('>= 3 AS fused_anomaly', '>= 2 AS fused_anomaly'))
def stream_score(spark, sf_dir):
    """Stateless detectors and their fusion, row by row on the stream."""
    from faultline.operators import detectors as D
    names = ["io_intensive", "resource_spike", "storage_anomaly"]
    s = fusion.explain(fusion.fuse(D.detect(_telemetry_stream(spark, sf_dir), names), names), names).select("event_id", "top_detectors", "fused_anomaly")
    return _finish(spark, s)


@query("SELECT event_id, detected, confidence, anomaly_type FROM (" + DETECTOR_SQL["detector_statistical_outlier"] + ")")
def stream_detect(spark, sf_dir):
    """A history detector on the stream equals the batch result."""
    at = _place(spark)
    J.detect_with_history(_telemetry_stream(spark, sf_dir), ["statistical_outlier"], f"{at}/out", f"{at}/state", f"{at}/ckpt").awaitTermination()
    d = F.col("statistical_outlier")
    return spark.read.parquet(f"{at}/out").select("event_id", d["detected"].alias("detected"), r(d["confidence"], 8).alias("confidence"), d["anomaly_type"].alias("anomaly_type"))


@query(f"""WITH RECURSIVE {TEL}, v AS (SELECT event_id, function_id, CASE WHEN anomaly_type <> 'benign' THEN 0.05 ELSE -0.05 END AS d, row_number() OVER (PARTITION BY function_id ORDER BY ts_us, event_id) AS rn FROM tel),
w AS (SELECT function_id, 0::BIGINT AS rn, 0.8::DOUBLE AS t, NULL::BIGINT AS event_id FROM (SELECT DISTINCT function_id FROM v) UNION ALL SELECT v.function_id, v.rn, greatest(0.1, least(1.0, w.t + v.d)), v.event_id FROM w JOIN v ON v.function_id = w.function_id AND v.rn = w.rn + 1)
SELECT event_id, round(t, 4) AS trust, rn AS position FROM w WHERE rn > 0""")
def stream_trust(spark, sf_dir):
    s = _telemetry_stream(spark, sf_dir).withColumn("trust_delta", F.expr("CASE WHEN anomaly_type <> 'benign' THEN 0.05D ELSE -0.05D END"))
    return _finish(spark, J.trust_stream(s)).select("event_id", r("trust", 4).alias("trust"), "position")


_RULES = f"""WITH RECURSIVE {TEL}, x AS (SELECT event_id % 3 AS shard, ts_us // 1000000 AS sec, execution_phase = 'error' AS bad, event_id % 4 = 1 AS tr, event_id % 4 = 2 AS sd, CASE WHEN event_id % 2 = 0 THEN cpu_utilization / 100 END AS perf FROM tel),
wm AS (SELECT (max(ts_us) - 5000000) // 1000000 AS w FROM tel),
s AS MATERIALIZED (SELECT shard, sec + 1 AS t, count(*) AS n, count(*) FILTER (WHERE tr) AS traces, count(*) FILTER (WHERE sd) AS sides, count(*) FILTER (WHERE bad) AS errors, count(perf) AS points, coalesce(sum(perf), 0) AS perf FROM x, wm WHERE sec + 1 <= w GROUP BY 1, 2),
g AS (SELECT shard, unnest(range(min(t), (SELECT w FROM wm) + 1)) AS t FROM s GROUP BY shard),
j AS (SELECT g.shard, g.t, n, errors, points, perf, max(CASE WHEN n > 0 THEN g.t END) OVER w AS la, max(CASE WHEN traces > 0 THEN g.t END) OVER w AS lt, max(CASE WHEN sides > 0 THEN g.t END) OVER w AS ls,
  sum(n) OVER e AS en, sum(errors) OVER e AS ee, sum(points) OVER p AS pp, sum(perf) OVER p AS ps FROM g LEFT JOIN s ON s.shard = g.shard AND s.t = g.t
  WINDOW w AS (PARTITION BY g.shard ORDER BY g.t), e AS (PARTITION BY g.shard ORDER BY g.t RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), p AS (PARTITION BY g.shard ORDER BY g.t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
c AS (SELECT shard, t, CASE WHEN t - la > 5 THEN 'no_telemetry' WHEN t - lt > 3 OR t - ls > 3 THEN 'data_missing' WHEN pp >= 10 AND round(ps / pp, 9) < 0.5 THEN 'performance' WHEN ee >= 3 AND ee / en > 0.2 THEN 'error_rate' END AS trig FROM j),
k AS MATERIALIZED (SELECT *, min(CASE WHEN trig IS NOT NULL THEN t END) OVER (PARTITION BY shard ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS soon FROM c),
r AS (SELECT shard, t, 0 AS step, NULL::VARCHAR AS was, trig, soon FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY t) AS rn FROM k WHERE trig IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT k.shard, k.t, step + 1, r.trig, k.trig, k.soon FROM r JOIN k ON k.shard = r.shard AND k.t = CASE WHEN r.trig IS NULL THEN r.soon ELSE r.t + 30 END)
"""


@query(_RULES + """SELECT shard, t AS second, CASE WHEN was IS NULL THEN 'NORMAL' ELSE 'DEGRADED' END AS previous, CASE WHEN trig IS NULL THEN 'NORMAL' ELSE 'DEGRADED' END AS mode, coalesce(trig, 'recovered') AS reason FROM r WHERE was IS DISTINCT FROM trig""")
def stream_fallback(spark, sf_dir):
    kind = F.expr("CASE event_id % 4 WHEN 1 THEN 'trace' WHEN 2 THEN 'side' ELSE 'telemetry' END")
    s = _telemetry_stream(spark, sf_dir).select(F.expr("CAST(event_id % 3 AS STRING)").alias("shard"), "ts", kind.alias("kind"), (F.col("execution_phase") == "error").alias("is_error"),
                                                F.expr("CASE WHEN event_id % 2 = 0 THEN cpu_utilization / 100 END").alias("performance"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("qos"))
    out = _finish(spark, J.fallback_stream(s, "shard"))
    return out.select(F.col("shard").cast("bigint").alias("shard"), (F.col("second") - EPOCH_US // 1_000_000).alias("second"), "previous", "mode", "reason")
