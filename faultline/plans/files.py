"""Queries: nested access, times, signing, latency, trust from feedback, and files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import evaluation as V, fusion, records, signing, traces as T
from faultline.plans.common import SCORED, TEL, Query, r
from faultline.plans.streams import _place
from faultline.plans.texts import _pad
from faultline.sources import readers
from faultline.sources.tables import scored_telemetry, table, telemetry

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing.x'), 'none') AS missing FROM events""")
def get_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", records.get_path(F.col("props"), "k", "none").alias("k"), records.get_path(F.col("props"), "missing.x", "none").alias("missing"))


@query(f"WITH {TEL} SELECT event_id, function_id, duration FROM tel")
def select_keys(spark, sf_dir):
    nested = telemetry(spark, sf_dir).select("event_id", "anomaly_type", F.struct("function_id", "duration", "cpu_utilization").alias("run"))
    return records.select_keys(nested, ["event_id", "run", "run.function_id", "run.duration", "absent"]).select("event_id", "run.*")


@query(f"WITH {TEL} SELECT event_id, function_id, duration + 1 AS duration, anomaly_type AS kind FROM tel")
def deep_merge(spark, sf_dir):
    both = telemetry(spark, sf_dir).select(
        "event_id", F.struct(F.struct("function_id", "duration").alias("run"), F.lit("x").alias("kind")).alias("a"), F.struct(F.struct((F.col("duration") + 1).alias("duration")).alias("run"), F.col("anomaly_type").alias("kind")).alias("b"))
    merged = records.deep_merge(F.col("a"), F.col("b"), both.schema["a"].dataType, both.schema["b"].dataType)
    return both.select("event_id", merged.alias("m")).select("event_id", "m.run.function_id", "m.run.duration", "m.kind")


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS compact, CAST(epoch_ms(date_trunc('second', ts)) AS VARCHAR) AS ms,
  greatest(0, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') // 1000000 - epoch_us(ts) // 1000000))::DOUBLE AS until FROM events""")
def timestamps(spark, sf_dir):
    seconds = F.expr("unix_seconds(CAST(ts AS TIMESTAMP))")
    return table(spark, sf_dir, "events").select("event_id", records.format_timestamp(seconds).alias("iso"), records.format_timestamp(seconds, "compact").alias("compact"),
                                                 records.format_timestamp(seconds, "milliseconds").alias("ms"), records.duration_between(seconds, F.lit(1705276800)).alias("until"))


_JSON = """'{"anomaly_type":"' || anomaly_type || '","cpu_utilization":' || cpu_utilization || ',"duration":' || duration || ',"event_id":' || event_id || ',"execution_phase":"' || execution_phase || '","function_id":"' || function_id
  || '","memory_spike_kb":' || memory_spike_kb || ',"network_io_bytes":' || network_io_bytes || ',"source":"primary","timestamp":' || ts_us || '}'"""


@query(f"""WITH {TEL}, c AS (SELECT event_id, sha256({_JSON}) AS h FROM tel)
SELECT event_id, h AS content_hash, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(h)))) AS signature, CASE WHEN event_id % 10 = 0 THEN 'hash_mismatch' WHEN event_id % 10 = 1 THEN 'bad_signature' END AS fault FROM c""")
def sign_records(spark, sf_dir):
    """All ten fields signed; one record in ten is changed afterwards, another gets a wrong signature."""
    t = signing.sign(telemetry(spark, sf_dir).withColumns({"source": F.lit("primary"), "timestamp": F.col("ts_us")}), "salt")
    bad = t.withColumns({"duration": F.when(F.col("event_id") % 10 == 0, F.col("duration") + 1).otherwise(F.col("duration")), "kept": F.col("signature"),
                         "signature": F.when(F.col("event_id") % 10 == 1, "0").otherwise(F.col("signature"))})
    return signing.verify(bad, "salt").select("event_id", "content_hash", F.col("kept").alias("signature"), "fault")


@query(f"""WITH {TEL}, x AS (SELECT event_id, function_id || '/' || (ts_us // 3600000000) AS batch, ts_us, cpu_utilization, duration + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS duration,
  lag(ts_us) OVER (PARTITION BY function_id || '/' || (ts_us // 3600000000) ORDER BY event_id) AS pt FROM tel), s AS (SELECT batch, count(*) AS n, avg(duration) AS m, stddev_pop(duration) AS sd FROM x GROUP BY 1),
f AS (SELECT batch, any_value(n) AS records, count(*) FILTER (WHERE event_id % 10 = 0) AS hash_mismatch, count(*) FILTER (WHERE event_id % 10 = 1) AS bad_signature,
  count(*) FILTER (WHERE n > 3 AND abs(duration - m) > 3 * sd) + count(*) FILTER (WHERE duration > 0.1 AND cpu_utilization = 0) + CAST(count(*) FILTER (WHERE ts_us < pt - 60000000) > any_value(n) * 0.1 AS INT) AS others FROM x JOIN s USING (batch) GROUP BY 1)
SELECT batch, records, hash_mismatch, bad_signature, CAST(others + hash_mismatch + bad_signature AS BIGINT) AS faults FROM f""")
def signed_integrity_faults(spark, sf_dir):
    """The changed records and wrong signatures of ``sign_records``, found per function and hour."""
    t = signing.sign(telemetry(spark, sf_dir).withColumns({"source": F.lit("primary"), "timestamp": F.col("ts_us")}), "salt")
    bad = t.withColumns({"duration": F.when(F.col("event_id") % 10 == 0, F.col("duration") + 1).otherwise(F.col("duration")),
                         "signature": F.when(F.col("event_id") % 10 == 1, "0").otherwise(F.col("signature")),
                         "batch": F.concat("function_id", F.lit("/"), F.expr("CAST(ts_us DIV 3600000000 AS STRING)"))})
    return T.integrity_faults(bad, "batch", "content_hash", key="salt").select("batch", "records", "hash_mismatch", "bad_signature", "faults")


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS hash,
  substr(md5('event_id:' || printf('%.2f', event_id::DOUBLE) || '|event_type:string|user_id:' || printf('%.2f', user_id::DOUBLE)), 1, 16) AS signature FROM events""")
def payload_hash_of(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.lit(1).alias("request_id"))
    return t.select("event_id", signing.payload_hash(t.columns).alias("hash"), signing.behavioural_signature(t, ["event_id", "event_type", "user_id"]).alias("signature"))


@query(f"""WITH {TEL}, x AS (SELECT *, duration * 2 AS a, cpu_utilization AS b, duration * 2 + cpu_utilization AS total, execution_phase = 'init' AS cold FROM tel), w AS (SELECT * FROM x WHERE NOT cold)
SELECT count(*) AS runs, round(avg(total), 4) AS mean_ms, round(quantile_cont(total, 0.5), 4) AS p50_ms, round(quantile_cont(total, 0.95), 4) AS p95_ms, round(quantile_cont(total, 0.99), 4) AS p99_ms, round(stddev_samp(total), 4) AS stdev_ms,
  CASE WHEN avg(a) >= avg(b) THEN 'a' ELSE 'b' END AS slowest_stage, round((SELECT avg(total) FROM x WHERE cold) - avg(total), 4) AS cold_overhead_ms FROM w""")
def latency_report(spark, sf_dir):
    t = telemetry(spark, sf_dir).select((F.col("duration") * 2).alias("a"), F.col("cpu_utilization").alias("b"), (F.col("duration") * 2 + F.col("cpu_utilization")).alias("total_ms"), (F.col("execution_phase") == "init").alias("cold"))
    out = V.latency_report(t, ["a", "b"])
    return out.select("runs", *[r(c, 4).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "stdev_ms", "cold_overhead_ms")], "slowest_stage")


@query(f"""WITH {TEL}, f AS (SELECT function_id AS detector, count(*) AS total, count(*) FILTER (WHERE anomaly_type = 'benign') AS accurate FROM tel GROUP BY 1)
SELECT detector, total, accurate, (CASE WHEN total < 10 THEN 0.7 WHEN accurate / total >= 0.9 THEN 1.0 WHEN accurate / total >= 0.7 THEN 0.7 WHEN accurate / total >= 0.5 THEN 0.4 ELSE 0.1 END)::DOUBLE AS trust FROM f""")
def detector_trust(spark, sf_dir):
    judged = telemetry(spark, sf_dir).select(F.col("function_id").alias("detector"), (F.col("anomaly_type") == "benign").alias("correct"))
    return fusion.detector_trust(judged)


@query(f"WITH {TEL} SELECT function_id, count(*) AS n, round(sum(duration), 4) AS total, CAST(sum(memory_spike_kb) AS BIGINT) AS memory FROM tel GROUP BY 1")
def csv_round_trip(spark, sf_dir):
    """Telemetry written as the flat log and read by its reader."""
    at = _place(spark)
    flat = telemetry(spark, sf_dir).select("anomaly_type", F.lit("c").alias("concurrency_id"), "duration", F.col("event_id").cast("string"), "execution_phase", F.lit(False).alias("fallback_mode"), F.col("function_id").alias("function_profile_id"),
                                           F.lit("{'v': 1}").alias("log_version"), "memory_spike_kb", F.lit("layer0").alias("source"), (F.col("ts_us") / 1e6).alias("timestamp"))
    flat.write.csv(f"{at}/csv", header=True)
    return readers.read_telemetry_csv(spark, f"{at}/csv").groupBy("function_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("duration"), 4).alias("total"), F.sum("memory_spike_kb").alias("memory"))


@query(f"""WITH {SCORED}, k AS (SELECT *, least(1, 0.3 * severity / 10 + 0.25 * adversarial_score + 0.2 * economic_risk_score + 0.15 * silent_failure_probability + 0.1 * (1 - confidence_level)) AS risk FROM sc)
SELECT CAST(CASE WHEN severity >= 8 OR risk >= 0.8 OR category IN ('security', 'silent_failure') THEN 10 WHEN fallback_mode THEN 8 WHEN anomaly_type <> 'benign' THEN 6 ELSE 3 END AS INT) AS priority, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM k GROUP BY 1""")
def priority_sink(spark, sf_dir):
    """Records routed to one folder per priority, read back."""
    at = _place(spark)
    records.write_by_priority(scored_telemetry(spark, sf_dir), f"{at}/routed")
    return spark.read.parquet(f"{at}/routed").groupBy(F.col("priority").cast("int").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {TEL} SELECT anomaly_type, count(*) AS n, round(avg(duration), 6) AS mean_duration FROM tel GROUP BY 1")
def report_round_trip(spark, sf_dir):
    at = _place(spark)
    report = telemetry(spark, sf_dir).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("duration")).alias("mean_duration"))
    readers.write_report(report, f"{at}/report")
    return spark.read.schema("anomaly_type string, n bigint, mean_duration double").json(f"{at}/report")
