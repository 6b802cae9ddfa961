"""Queries of cost, silent failure, quality, health, channels, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import economic as E, operations as O, preservation as P, silent as S
from faultline.operators.quantiles import exact_quantiles
from faultline.plans.common import TEL, Query, r
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


def _orders(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", "o_custkey", F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP))").alias("at"), F.col("o_totalprice").alias("cost"))


_COST = """0.0000002 + 0.0000166667 * 0.125 * duration * CASE WHEN cpu_utilization > 80 THEN 1.2 ELSE 1.0 END * CASE WHEN memory_spike_kb > 100000 THEN 1.1 ELSE 1.0 END"""
_O = "o AS (SELECT o_orderkey, o_custkey, o_orderdate AS at, o_totalprice AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query(f"WITH {TEL} SELECT event_id, round(({_COST}) * 1e6, 6) AS micro_cost FROM tel")
def invocation_cost(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", r(E.invocation_cost() * 1e6).alias("micro_cost"))


@query(f"""WITH {_O} SELECT o_custkey, count(*) AS n, round(avg(cost), 6) AS mean, round(stddev_pop(cost), 6) AS stdev, round(quantile_cont(cost, 0.5), 6) AS median,
  round(stddev_pop(cost) / avg(cost), 6) AS variation, round(CASE WHEN stddev_pop(cost) > 0 THEN least(1, greatest(max(cost) - avg(cost), avg(cost) - min(cost)) / stddev_pop(cost) / 5) ELSE 0 END, 6) AS anomaly_score
FROM o GROUP BY o_custkey""")
def cost_stats(spark, sf_dir):
    out = E.cost_stats(_orders(spark, sf_dir), ["o_custkey"], "cost")
    return out.select("o_custkey", "n", *[r(c).alias(c) for c in ("mean", "stdev", "median")], r("variation").alias("variation"), r("anomaly_score").alias("anomaly_score"))


@query(f"""WITH {_O}, l AS (SELECT o_custkey, list(cost ORDER BY cost) AS v, count(*) AS n, avg(cost) AS mu, coalesce(nullif(stddev_pop(cost), 0), 1e-6) AS sd, median(cost) AS med FROM o GROUP BY 1),
d AS (SELECT o.*, l.v, l.mu, l.sd, l.med, abs(cost - med) AS dev, v[l.n // 4 + 1] AS q1, v[3 * l.n // 4 + 1] AS q3 FROM o JOIN l USING (o_custkey)),
m AS (SELECT *, median(dev) OVER (PARTITION BY o_custkey) AS mad FROM d)
SELECT o_orderkey, n >= 3 AND abs(cost - mu) / sd > 3 AS by_z, n >= 4 AND (cost < q1 - 1.5 * (q3 - q1) OR cost > q3 + 1.5 * (q3 - q1)) AS by_iqr, n >= 3 AND mad > 0 AND dev > 3 * 1.4826 * mad AS by_mad
FROM m WHERE (n >= 3 AND abs(cost - mu) / sd > 3) OR (n >= 4 AND (cost < q1 - 1.5 * (q3 - q1) OR cost > q3 + 1.5 * (q3 - q1))) OR (n >= 3 AND mad > 0 AND dev > 3 * 1.4826 * mad)""")
def cost_spikes(spark, sf_dir):
    return E.cost_spikes(_orders(spark, sf_dir), ["o_custkey"], "cost").select("o_orderkey", "by_z", "by_iqr", "by_mad")


@query(f"""WITH {_O}, p AS (SELECT *, lag(cost) OVER (PARTITION BY o_custkey ORDER BY rn) AS pc FROM o)
SELECT o_custkey, round(greatest(-1, least(1, CASE WHEN count(*) > 1 THEN regr_slope(cost, rn) ELSE 0 END * count(*) / avg(cost))), 6) AS trend, round(coalesce(stddev_pop((cost - pc) / pc), 0), 4) AS volatility FROM p GROUP BY 1""")
def cost_trend(spark, sf_dir):
    out = E.cost_trend(_orders(spark, sf_dir), ["o_custkey"], "cost", "at", "o_orderkey")
    return out.select("o_custkey", r("trend").alias("trend"), r("volatility", 4).alias("volatility"))


@query(f"""WITH {_O}, x AS (SELECT *, cost - avg(cost) OVER (PARTITION BY o_custkey) AS x FROM o WHERE n >= 10),
d AS (SELECT o_custkey, sum(x * x) AS d FROM x GROUP BY 1),
c AS (SELECT a.o_custkey, b.rn - a.rn AS k, any_value(a.n) AS n, sum(a.x * b.x) / any_value(d) AS corr FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND b.rn - a.rn BETWEEN 1 AND 24 JOIN d ON d.o_custkey = a.o_custkey GROUP BY 1, 2),
p AS (SELECT unnest([2, 3, 4, 5, 6, 7, 12, 24]) AS period)
SELECT o_custkey, CAST(period AS INT) AS period, round(max(corr), 6) AS corr, max(corr) > 0.6 AS periodic FROM c JOIN p ON n >= 2 * period AND k <= period AND k < n // 2 GROUP BY 1, 2""")
def cost_periodicity(spark, sf_dir):
    out = E.cost_periodicity(_orders(spark, sf_dir), ["o_custkey"], "cost", "at", "o_orderkey")
    return out.select("o_custkey", "period", r("corr").alias("corr"), "periodic")


@query(f"""WITH {_O}, v AS (SELECT *, var_pop(cost) OVER (PARTITION BY o_custkey ORDER BY rn ROWS BETWEEN (least(5, n // 3) - 1) PRECEDING AND CURRENT ROW) AS v FROM o WHERE n >= 5)
SELECT o_custkey, round(least(1, max(v) / coalesce(nullif(avg(v), 0), 1e-6) / 10), 6) AS burst FROM v WHERE rn >= least(5, n // 3) GROUP BY 1""")
def cost_burst(spark, sf_dir):
    return E.cost_burst(_orders(spark, sf_dir), ["o_custkey"], "cost", "at", "o_orderkey").select("o_custkey", r("burst").alias("burst"))


_IND = f"""WITH {TEL}, c AS (SELECT *, {_COST} AS cost, (ts_us - lag(ts_us) OVER (PARTITION BY function_id ORDER BY ts_us, event_id)) / 1e6 AS gap FROM tel),
i AS (SELECT function_id, count(*) AS n, sum(cost) AS total_cost, avg(cpu_utilization) AS avg_cpu, avg(duration) AS avg_duration, sum(duration) AS sd,
  (max(ts_us) - min(ts_us)) / 1e6 AS span, min(gap) AS g, greatest(max(cost) - avg(cost), avg(cost) - min(cost)) / stddev_pop(cost) / 5 AS an FROM c GROUP BY 1)"""


@query(_IND + """ SELECT function_id, n, round(total_cost * 1e6, 4) AS micro_total, round(avg_duration, 6) AS avg_duration, round(n / greatest(span, 1), 8) AS invocation_rate,
  round(least(2, span / (n - 1) / coalesce(nullif(g, 0), 1e-6) / 10), 6) AS burst_factor, round(total_cost / sd * 1e6, 6) AS micro_per_second, round(avg_cpu * avg_duration / 100, 6) AS resource_efficiency FROM i""")
def economic_indicators(spark, sf_dir):
    out = E.indicators(telemetry(spark, sf_dir))
    return out.select("function_id", "n", r(F.col("total_cost") * 1e6, 4).alias("micro_total"), r("avg_duration").alias("avg_duration"), r("invocation_rate", 8).alias("invocation_rate"),
                      r("burst_factor").alias("burst_factor"), r(F.col("cost_per_second") * 1e6).alias("micro_per_second"), r("resource_efficiency").alias("resource_efficiency"))


@query(_IND + """, s AS (SELECT *, CASE WHEN n / greatest(span, 1) >= 100 THEN 0.4 ELSE 0 END + CASE WHEN total_cost / greatest(n * 0.0001, 1e-6) >= 5 THEN 0.3 ELSE 0 END AS dow,
  CASE WHEN avg_cpu >= 80 THEN 0.3 ELSE 0 END + CASE WHEN avg_duration >= 30 THEN 0.2 ELSE 0 END AS cr FROM i)
SELECT function_id, CASE WHEN greatest(dow, cr) < 0.4 THEN NULL WHEN dow >= cr THEN 'denial_of_wallet' ELSE 'cryptomining' END AS attack,
  round(least(1, CASE WHEN greatest(dow, cr) < 0.4 THEN 0 ELSE greatest(dow, cr) END * 0.4 + least(1, an) * 0.3 + CASE WHEN avg_cpu > 80 THEN 0.1 ELSE 0 END + CASE WHEN n / greatest(span, 1) > 5 THEN 0.1 ELSE 0 END
    + CASE WHEN total_cost > 0.01 THEN 0.1 ELSE 0 END), 6) AS risk FROM s""")
def economic_risk(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    out = E.batch_risk(E.indicators(t), E.cost_stats(t.withColumn("cost", E.invocation_cost()), ["function_id"], "cost"))
    return out.select("function_id", "attack", r("risk").alias("risk"))


@query(f"""WITH {TEL}, c AS (SELECT *, {_COST} AS cost FROM tel), h AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY ts_us, event_id) AS rn FROM c),
q AS (SELECT *, least(1000, rn - min(rn) OVER (PARTITION BY function_id ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) + 1) AS k FROM h),
p AS (SELECT *, avg(cost) OVER (PARTITION BY function_id ORDER BY rn ROWS BETWEEN (k - 1) PRECEDING AND CURRENT ROW) AS m FROM q)
SELECT event_id, k AS recent_count, round(m * 1e6, 3) AS micro_recent, CASE WHEN k / 60.0 > 10 THEN 'high_frequency' WHEN k / 60.0 > 1 THEN 'moderate_frequency' ELSE 'normal_frequency' END AS pattern,
  CASE WHEN greatest(dow, cr) < 0.3 THEN NULL WHEN dow >= cr THEN 'denial_of_wallet' ELSE 'cryptomining' END AS attack
FROM (SELECT *, CASE WHEN k / 60.0 > 5 THEN 0.3 ELSE 0 END + CASE WHEN cost / greatest(duration, 0.001) > 0.001 THEN 0.4 ELSE 0 END + CASE WHEN cpu_utilization > 90 THEN 0.3 ELSE 0 END AS dow,
  CASE WHEN cpu_utilization > 80 AND duration > 10 THEN 0.5 ELSE 0 END + CASE WHEN network_io_bytes < 1024 THEN 0.2 ELSE 0 END + CASE WHEN memory_spike_kb > 100000 THEN 0.3 ELSE 0 END AS cr FROM p)""")
def attack_type(spark, sf_dir):
    out = E.attack_type(E.invocation_pattern(telemetry(spark, sf_dir)))
    return out.select("event_id", F.col("recent_count").cast("bigint").alias("recent_count"), r(F.col("recent_cost") * 1e6, 3).alias("micro_recent"), "pattern", "attack")


_CAL = f"""WITH {TEL}, a AS (SELECT *, memory_spike_kb / 1024.0 AS mb, 0.0000166667 * (memory_spike_kb / 1048576.0) * duration + 0.0000002 + network_io_bytes / 1073741824.0 * 0.00001 AS cost FROM tel),
s AS (SELECT *, least(1, CASE WHEN cost / 0.000021 > 2 THEN least(0.4, (cost / 0.000021 - 2) / 8) ELSE 0 END + CASE WHEN duration * 1000 / 150 > 1.5 THEN least(0.3, (duration * 1000 / 150 - 1.5) / 5) ELSE 0 END
    + CASE WHEN mb / 45 > 2 THEN least(0.2, (mb / 45 - 2) / 8) ELSE 0 END + CASE WHEN execution_phase = 'error' THEN 0.1 ELSE 0 END) AS dow,
  least(1, CASE WHEN cpu_utilization / 15 > 3 THEN least(0.5, (cpu_utilization / 15 - 3) / 7) ELSE 0 END + CASE WHEN duration > 10 THEN least(0.3, (duration * 1000 - 10000) / 50000) ELSE 0 END
    + CASE WHEN network_io_bytes / greatest(mb * 1048576, 1) < 0.1 THEN 0.2 ELSE 0 END) AS cm,
  least(1, CASE WHEN mb / 45 > 10 THEN least(0.6, (mb / 45 - 10) / 50) ELSE 0 END + CASE WHEN duration < 2 AND mb > 200 THEN 0.1 ELSE 0 END) AS am,
  CASE WHEN mb > 50 AND mb < 150 THEN 0.2 ELSE 0 END + CASE WHEN duration > 0.5 AND duration < 3 THEN 0.3 ELSE 0 END + CASE WHEN network_io_bytes > 1024 AND network_io_bytes < 10485760 THEN 0.2 ELSE 0 END AS lc FROM a),
k AS (SELECT *, greatest(dow, cm, am, lc) AS score FROM s)
"""


@query(_CAL + """SELECT event_id, round(dow, 6) AS dow, round(cm, 6) AS crypto_mining, round(am, 6) AS amplification, round(CAST(lc AS DOUBLE), 6) AS lambda_chaining FROM k""")
def attack_scores_calibrated(spark, sf_dir):
    out = E.calibrated_scores(telemetry(spark, sf_dir))
    return out.select("event_id", *[r(c).alias(c) for c in ("dow", "crypto_mining", "amplification", "lambda_chaining")])


@query(_CAL + """, t AS (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])::DOUBLE AS threshold),
f AS (SELECT function_id, threshold, count(*) AS samples, count(*) FILTER (WHERE round(score, 9) >= threshold) AS fp FROM k, t WHERE anomaly_type = 'benign' GROUP BY 1, 2)
SELECT function_id, threshold, samples, fp AS false_positives, round(fp / samples, 6) AS fpr, min(CASE WHEN fp / samples <= 0.05 THEN threshold END) OVER (PARTITION BY function_id) AS target_threshold FROM f""")
def false_alarm_control(spark, sf_dir):
    t = E.calibrated_scores(telemetry(spark, sf_dir)).where("anomaly_type = 'benign'").withColumn("attack_score", F.round("attack_score", 9))
    return E.false_alarm_control(t, "function_id").withColumn("fpr", r("fpr"))


# --- silent failure: input and output payloads derived from events ---

def _io(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'billing_service' WHEN 'signup' THEN 'auth_service' WHEN 'click' THEN 'ml_inference' ELSE 'other' END")
    out = F.expr("""CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 41 = 0 THEN '{"v":NaN}' ELSE concat('{"prediction":1,"confidence":', CAST(event_id % 12 / 10D AS STRING), ',"status":"',
        CASE WHEN event_id % 8 = 0 THEN 'odd' ELSE 'ok' END, '","user_id":', user_id, ',"amount":', event_id % 9 - 1, ',"currency":"', CASE WHEN event_id % 6 = 0 THEN 'XYZ' ELSE 'EUR' END,
        '","correlation_id":"', CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END, '"}') END""")
    return t.select("event_id", kind.alias("kind"), F.expr("""concat('{"correlation_id":"', event_id, '","user_id":', user_id, '}')""").alias("inp"), out.alias("outp"),
                    F.expr("array(1D, 2D, 3D, 4D, 5D + event_id % 3)").alias("nums"), F.expr("transform(sequence(1, 5), i -> CAST(i + event_id % 40 AS DOUBLE))").alias("outs"), F.col("value").alias("duration"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'billing_service' WHEN 'signup' THEN 'auth_service' WHEN 'click' THEN 'ml_inference' ELSE 'other' END AS kind,
  event_id % 50 = 0 AS nul, event_id % 41 = 0 AND event_id % 50 <> 0 AS bad FROM events),
s AS (SELECT event_id, CASE WHEN nul THEN 0.05 WHEN bad THEN 0.2 ELSE 0.7 END::DOUBLE AS consistency,
  CASE kind WHEN 'ml_inference' THEN CASE WHEN nul OR bad THEN 0.3 WHEN event_id % 12 > 10 THEN 0.35 ELSE 0.75 END
            WHEN 'auth_service' THEN CASE WHEN nul OR bad THEN 0.3 WHEN event_id % 8 = 0 THEN 0.4 ELSE 0.75 END
            WHEN 'billing_service' THEN CASE WHEN nul OR bad THEN 0.3 WHEN event_id % 6 = 0 THEN 0.4 WHEN event_id % 9 = 0 THEN 0.4 ELSE 0.75 END ELSE 0.75 END::DOUBLE AS func,
  (CASE WHEN NOT nul AND NOT bad AND event_id % 4 <> 0 THEN 0.35 ELSE 0 END + 0.30 + CASE WHEN NOT nul AND NOT bad THEN 0.325 ELSE 0 END)::DOUBLE / 0.975 AS inv,
  CASE WHEN value < 0 THEN 0.4 WHEN value > 60 THEN 0.45 ELSE 0.65 END::DOUBLE AS trace, abs(event_id % 40) / (1.4826 * 1) AS z FROM e),
c AS (SELECT *, CASE WHEN z > 6 THEN greatest(0.25, 1 - 0.5 * least(1, z / 10)) ELSE 1.0 END::DOUBLE AS cor FROM s)
SELECT event_id, consistency, func AS function, round(inv, 6) AS invariant, round(cor, 6) AS corruption, trace, round(greatest(0, least(1, 0.15 + 0.85 * (0.22 * (1 - CASE WHEN consistency >= 0.5 THEN consistency ELSE 0 END)
  + 0.22 * (1 - CASE WHEN func >= 0.5 THEN func ELSE 0 END) + 0.18 * (1 - inv) + 0.18 * (1 - cor) + 0.10 * (1 - CASE WHEN trace >= 0.5 THEN trace ELSE 0 END) + 0.10 * (1 - 0.8)))), 6) AS failure_probability FROM c""")
def silent_failure(spark, sf_dir):
    t = _io(spark, sf_dir).withColumns({
        "consistency": S.io_consistency("outp"), "function": S.function_rules("kind", "outp"),
        "invariant": S.invariants("inp", "outp", preserve=["user_id"]), "corruption": S.corruption("outp", F.col("nums"), F.col("outs")),
        "trace": S.trace_semantics(F.array(F.lit(1), F.lit(2)), F.array(F.lit("INIT"), F.lit("INVOKE")), F.col("duration")), "sanity": F.lit(0.8)})
    out = S.failure_probability(t)
    return out.select("event_id", *[r(c).alias(c) for c in ("consistency", "function", "invariant", "corruption", "trace", "failure_probability")])


# --- quality ---

_DQ = f"""WITH {TEL}, d AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN duration END AS dur, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE function_id END AS fn, 'v' || (event_id % 2) AS schema_version, ts_us // 3600000000 AS batch FROM tel),
q AS (SELECT batch, count(*) AS records, 1 - count(*) FILTER (WHERE dur IS NULL) / (count(*) * 4) AS completeness, (count(*) * 3 - count(*) FILTER (WHERE dur IS NULL) - count(*) FILTER (WHERE event_id % 11 = 0)) / (count(*) * 3) AS accuracy,
  0.4 / count(DISTINCT schema_version) + 0.3 / count(DISTINCT anomaly_type) + 0.3 / count(DISTINCT execution_phase) AS consistency, avg(CAST(21600000000 - ts_us <= 300000000 AS INT)) AS timeliness,
  avg(CAST(dur IS NOT NULL AS INT)) AS validity, 1.0::DOUBLE AS integrity FROM d GROUP BY 1),
o AS (SELECT *, completeness * 0.25 + accuracy * 0.25 + consistency * 0.2 + timeliness * 0.15 + validity * 0.1 + integrity * 0.05 AS overall FROM q)
"""


def _quality(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumns({
        "duration": F.expr("CASE WHEN event_id % 7 <> 0 THEN duration END"), "function_id": F.expr("CASE WHEN event_id % 11 = 0 THEN ' ' ELSE function_id END"),
        "schema_version": F.expr("concat('v', event_id % 2)"), "batch": F.expr("ts_us DIV 3600000000")})
    return O.batch_quality(t, "batch", ["event_id", "ts_us", "duration", "anomaly_type"], ["function_id", "duration", "anomaly_type"], "21600000000")


@query(_DQ + """SELECT batch, records, round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(consistency, 6) AS consistency, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall,
  CASE WHEN overall >= 0.95 THEN 'excellent' WHEN overall >= 0.85 THEN 'good' WHEN overall >= 0.75 THEN 'acceptable' WHEN overall >= 0.6 THEN 'poor' ELSE 'unacceptable' END AS level FROM o""")
def batch_quality(spark, sf_dir):
    return _quality(spark, sf_dir).select("batch", "records", *[r(c).alias(c) for c in ("completeness", "accuracy", "consistency", "timeliness", "overall")], "level")


@query(_DQ + """SELECT batch, metric, round(score, 6) AS score FROM (UNPIVOT (SELECT batch, completeness, accuracy, consistency, timeliness, validity, integrity FROM o) ON completeness, accuracy, consistency, timeliness, validity, integrity INTO NAME metric VALUE score)
  WHERE score < CASE WHEN metric IN ('timeliness', 'integrity') THEN 0.9 ELSE 0.8 END""")
def quality_alerts(spark, sf_dir):
    return O.quality_alerts(_quality(spark, sf_dir), "batch").select("batch", "metric", r("score").alias("score"))


@query(_DQ + """, u AS (UNPIVOT (SELECT batch, completeness, accuracy, consistency, timeliness, validity, integrity FROM o) ON completeness, accuracy, consistency, timeliness, validity, integrity INTO NAME metric VALUE score),
n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY batch) AS rn, count(*) OVER (PARTITION BY metric) AS k FROM u),
g AS (SELECT metric, any_value(k) AS points, avg(score) AS average, stddev_pop(score) AS volatility, avg(score) FILTER (WHERE rn <= k // 2) AS a, avg(score) FILTER (WHERE rn > k // 2) AS b FROM n GROUP BY 1)
SELECT metric, points, round(average, 6) AS average, round(volatility, 6) AS volatility, CASE WHEN points < 2 THEN 'stable' WHEN b > a * 1.05 THEN 'improving' WHEN b < a * 0.95 THEN 'declining' ELSE 'stable' END AS direction FROM g""")
def quality_trend(spark, sf_dir):
    return O.quality_trend(_quality(spark, sf_dir), "batch").select("metric", "points", r("average").alias("average"), r("volatility").alias("volatility"), "direction")


# --- health ---

_STATUS = f"""WITH {TEL}, st AS (SELECT event_id, function_id AS component, ts_us, CASE anomaly_type WHEN 'timeout_fallback' THEN 'critical' WHEN 'execution_failure' THEN 'failed' WHEN 'memory_spike' THEN 'degraded' ELSE 'healthy' END AS status FROM tel),
pv AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY component ORDER BY ts_us, event_id), 'unknown') AS previous FROM st),
ch AS (SELECT * FROM pv WHERE status <> previous)
"""


def _status(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", F.col("function_id").alias("component"), "ts_us", F.expr(
        "CASE anomaly_type WHEN 'timeout_fallback' THEN 'critical' WHEN 'execution_failure' THEN 'failed' WHEN 'memory_spike' THEN 'degraded' ELSE 'healthy' END").alias("status"))


@query(_STATUS + "SELECT event_id, component, previous, status, CASE status WHEN 'failed' THEN 'critical' WHEN 'critical' THEN 'error' WHEN 'degraded' THEN 'warning' ELSE 'info' END AS alert FROM ch")
def status_alerts(spark, sf_dir):
    return O.transitions(_status(spark, sf_dir), "component").select("event_id", "component", "previous", "status", "alert")


@query(_STATUS.replace("WITH tel", "WITH RECURSIVE tel", 1) + """, sd AS (SELECT component, ts_us, CASE WHEN previous = 'healthy' AND status IN ('failed','critical') THEN 1 WHEN previous IN ('failed','critical') AND status = 'healthy' THEN -1 END AS d,
    event_id FROM ch), sn AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts_us, event_id) AS rn FROM sd WHERE d IS NOT NULL),
q AS (SELECT component, 0::BIGINT AS rn, 0 AS open, 0 AS before, 0 AS d, 0::BIGINT AS ts_us FROM (SELECT DISTINCT component FROM sn)
  UNION ALL SELECT sn.component, sn.rn, greatest(0, q.open + sn.d), q.open, sn.d, sn.ts_us FROM q JOIN sn ON sn.component = q.component AND sn.rn = q.rn + 1),
b AS (SELECT component, ts_us, row_number() OVER (PARTITION BY component ORDER BY rn) AS k FROM q WHERE d = 1),
e AS (SELECT component, ts_us, row_number() OVER (PARTITION BY component ORDER BY rn) AS k FROM q WHERE d = -1 AND before > 0),
i AS (SELECT b.component, (e.ts_us - b.ts_us) / 1e6 AS rec FROM b JOIN e USING (component, k))
SELECT component, count(*) AS incidents, round(avg(rec), 4) AS avg_s, round(median(rec), 4) AS median_s, round(max(rec), 4) AS max_s, avg(rec) <= 300 AS meets_sla FROM i GROUP BY 1 HAVING count(*) >= 3""")
def mttr(spark, sf_dir):
    inc = O.incidents(O.transitions(_status(spark, sf_dir), "component"), "component")
    return O.mttr(inc, "component").select("component", "incidents", *[r(c, 4).alias(c) for c in ("avg_s", "median_s", "max_s")], "meets_sla")


@query(f"""WITH {TEL}, g AS (SELECT event_id, function_id, (ts_us - lag(ts_us) OVER (PARTITION BY function_id ORDER BY ts_us, event_id)) / 1e6 AS gap FROM tel)
SELECT event_id, CAST(floor(gap) - 3 AS BIGINT) AS missed, floor(gap) - 3 >= 3 AS dead FROM g WHERE floor(gap) - 3 > 0""")
def missed_heartbeats(spark, sf_dir):
    return O.missed_heartbeats(telemetry(spark, sf_dir), "function_id").select("event_id", "missed", "dead")


@query(_STATUS + """, l AS (SELECT component, arg_max(status, (ts_us, event_id)) AS status FROM st GROUP BY 1)
SELECT count(*) AS components, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'critical') AS critical, count(*) FILTER (WHERE status = 'degraded') AS degraded, count(*) FILTER (WHERE status = 'healthy') AS healthy,
  CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (WHERE status = 'degraded') > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM l""")
def system_health(spark, sf_dir):
    return O.system_health(_status(spark, sf_dir), "component")


# --- channels: a function is a channel, an error or timeout opens an outage as long as its duration in minutes ---

_OUT = f"""WITH {TEL}, o AS (SELECT function_id AS channel, ts_us AS s, ts_us + CAST(round(duration * 6000000) AS BIGINT) AS e FROM tel WHERE anomaly_type IN ('execution_failure', 'timeout_fallback') AND duration > 0)
"""


def _outages(spark, sf_dir):
    return telemetry(spark, sf_dir).where("anomaly_type IN ('execution_failure', 'timeout_fallback') AND duration > 0").select(
        F.col("function_id").alias("channel"), F.col("ts_us").alias("s"), F.expr("ts_us + CAST(round(duration * 6000000) AS BIGINT)").alias("e"))


@query(_OUT + "SELECT a.channel AS a, b.channel AS b, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap_us FROM o a JOIN o b ON a.channel < b.channel AND greatest(a.s, b.s) < least(a.e, b.e) GROUP BY 1, 2")
def failure_overlap(spark, sf_dir):
    return O.outage_overlaps(_outages(spark, sf_dir), slot=120_000_000).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap_us").alias("overlap_us"))


@query(_OUT + "SELECT a.channel AS trigger, b.channel AS triggered, count(*) AS n, round(avg(b.s - a.s) / 1e6, 4) AS mean_delay_s FROM o a JOIN o b ON a.channel <> b.channel AND b.s > a.s AND b.s <= a.s + 60000000 GROUP BY 1, 2")
def outage_cascade(spark, sf_dir):
    out = O.outage_cascades(_outages(spark, sf_dir), window_us=60_000_000)
    return out.groupBy("trigger", "triggered").agg(F.count(F.lit(1)).alias("n"), r(F.avg("delay_us") / 1e6, 4).alias("mean_delay_s"))


@query(_OUT + """, g AS (SELECT DISTINCT channel AS ch, unnest(range(s // 36000000, e // 36000000)) AS i FROM o), n AS (SELECT greatest(1200, CAST(ceil(max(e) / 36000000.0) AS BIGINT)) AS n FROM o), k AS (SELECT ch, count(*) AS k FROM g GROUP BY 1),
p AS (SELECT x.ch AS a, y.ch AS b, count(*) AS k2 FROM g x JOIN g y ON x.i = y.i AND x.ch < y.ch GROUP BY 1, 2)
SELECT ka.ch AS a, kb.ch AS b, coalesce(k2, 0) AS shared, round((n * coalesce(k2, 0) - ka.k * kb.k) / sqrt(ka.k::DOUBLE * (n - ka.k) * kb.k * (n - kb.k)), 6) AS corr FROM n, k ka JOIN k kb ON ka.ch < kb.ch LEFT JOIN p ON p.a = ka.ch AND p.b = kb.ch""")
def failure_correlation(spark, sf_dir):
    return O.outage_correlation(_outages(spark, sf_dir), 43_200_000_000, 36_000_000).select("a", "b", F.col("k2").alias("shared"), r("corr").alias("corr"))


_CH = f"""WITH {TEL}, c AS (SELECT function_id AS channel, count(*) AS n, avg(duration) * 100 AS latency_ms, count(*) / 1.0 AS throughput, avg(CAST(anomaly_type = 'benign' AS INT)) AS availability, avg(duration) / 20000 AS cost,
  count(*) FILTER (WHERE execution_phase = 'error') / 20.0 AS failures FROM tel GROUP BY 1),
q AS (SELECT *, greatest(0, least(1, 0.4 * greatest(0, 1 - latency_ms / 1000) + 0.3 * least(1, throughput / 1000) + 0.2 * availability + 0.1 * (1 - cost * 1000))) AS qos FROM c)
"""


def _channels(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(F.col("function_id").alias("channel")).agg(
        (F.avg("duration") * 100).alias("latency_ms"), F.count(F.lit(1)).cast("double").alias("throughput"), F.avg((F.col("anomaly_type") == "benign").cast("int")).alias("availability"),
        (F.avg("duration") / 20000).alias("cost"), (F.count_if(F.col("execution_phase") == "error") / 20).alias("failures"))


@query(_CH + """SELECT channel, round(qos, 6) AS qos, CASE WHEN qos >= 0.9 THEN 'Primary channel - excellent performance' WHEN qos >= 0.7 THEN 'Secondary channel - good performance' WHEN qos >= 0.5 THEN 'Fallback channel - acceptable performance'
  ELSE 'Emergency channel - minimal performance' END || CASE WHEN cost < 0.001 THEN ' - low cost' WHEN cost < 0.01 THEN ' - moderate cost' ELSE ' - high cost' END AS recommendation FROM q WHERE cost <= 0.01""")
def rank_channels(spark, sf_dir):
    return O.rank_channels(O.channel_qos(_channels(spark, sf_dir)), "cost").select("channel", r("qos").alias("qos"), "recommendation")


@query(_CH + """, h AS (SELECT channel, greatest(0, 1 - failures / 10) AS health FROM q)
SELECT channel, round(health, 6) AS health, round(least(1, (SELECT avg(health) FROM h) + least(0.2, (SELECT count(*) FROM h WHERE health > 0.7) * 0.05)), 6) AS overall FROM h""")
def channel_health(spark, sf_dir):
    return O.channel_health(_channels(spark, sf_dir)).select("channel", r("health").alias("health"), r("overall").alias("overall"))


@query(_CH + "SELECT channel, round(qos, 6) AS health FROM q WHERE availability >= 0.7 AND channel <> 'fn_00' ORDER BY qos DESC, failures, channel LIMIT 3")
def failover_candidates(spark, sf_dir):
    t = O.channel_qos(_channels(spark, sf_dir)).withColumns({"healthy": F.col("availability") >= 0.7, "active": F.col("channel") == "fn_00", "health": F.col("qos")})
    return O.failover_candidates(t, 3).select("channel", r("health").alias("health"))


@query(f"""WITH {TEL}, s AS (SELECT function_id AS channel, event_id // 3 AS grp, anomaly_type <> 'benign' AS lost FROM tel), m AS (SELECT avg(CAST(x AS INT)) * 1e6 AS ppm FROM (SELECT grp, bool_and(lost) AS x FROM s GROUP BY 1)),
o AS (SELECT channel, count(*) AS events, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS lost FROM s GROUP BY 1)
SELECT channel, events, lost, round(lost / events * 1e6, 4) AS single_ppm, round(ppm, 4) AS multi_ppm, round((lost / events * 1e6 - ppm) / (lost / events * 1e6) * 100, 6) AS reduction_percent FROM o, m""")
def loss_rate(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(F.col("function_id").alias("channel"), F.expr("event_id DIV 3").alias("grp"), (F.col("anomaly_type") != "benign").alias("lost"))
    return O.loss_rate(t, "channel", "lost", "grp").select("channel", "events", "lost", r("single_ppm", 4).alias("single_ppm"), r("multi_ppm", 4).alias("multi_ppm"), r("reduction_percent").alias("reduction_percent"))


@query("""WITH v AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS k FROM lineitem GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC, v) AS rn, sum(k) OVER (PARTITION BY l_orderkey) AS t FROM v)
SELECT l_orderkey, v AS consensus, k AS votes, CAST(t AS BIGINT) AS replicas FROM w WHERE rn = 1""")
def majority_vote(spark, sf_dir):
    return O.majority_vote(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query(f"""WITH {TEL} SELECT function_id, count(*) AS n, round(avg(CAST(anomaly_type = 'benign' AS INT)), 6) AS success_rate, round(avg(duration) FILTER (WHERE anomaly_type = 'benign'), 6) AS mean_latency,
  round(quantile_cont(duration, 0.99) FILTER (WHERE anomaly_type = 'benign'), 6) AS p99_latency, round(stddev_pop(duration) FILTER (WHERE anomaly_type = 'benign') / avg(duration) FILTER (WHERE anomaly_type = 'benign'), 6) AS stability FROM tel GROUP BY 1""")
def channel_success(spark, sf_dir):
    out = O.channel_success(telemetry(spark, sf_dir), "function_id", "anomaly_type = 'benign'", "duration")
    return out.select("function_id", "n", *[r(c).alias(c) for c in ("success_rate", "mean_latency", "p99_latency", "stability")])


# --- sampling ---

_SMP = f"""WITH {TEL}, w AS (SELECT *, row_number() OVER h AS n, lag(ts_us) OVER h AS pt, avg(duration) OVER k AS ad, avg(memory_spike_kb) OVER k AS am, avg(cpu_utilization) OVER k AS ac, var_samp(duration) OVER k AS vd, quantile_cont(duration, 0.95) OVER k AS p95
  FROM tel WINDOW h AS (PARTITION BY function_id ORDER BY ts_us, event_id), k AS (PARTITION BY function_id ORDER BY ts_us, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN coalesce((ts_us - pt) / 1e6, 0) > 300 OR memory_spike_kb < 0.5 * am OR memory_spike_kb > 2 * am THEN 'cold_start' WHEN coalesce((ts_us - pt) / 1e6, 0) BETWEEN 30 AND 300 THEN 'warm_start'
  WHEN p95 > 0 AND duration > p95 * 1.5 THEN 'high_latency' WHEN memory_spike_kb > am * 1.3 THEN 'memory_pressure' WHEN cpu_utilization > 80 THEN 'cpu_intensive' ELSE 'hot_execution' END AS state,
  CASE WHEN p95 > 0 AND duration > p95 * 2 THEN 'latency_spike' WHEN am > 0 AND memory_spike_kb > am * 1.5 THEN 'memory_spike' WHEN ac > 0 AND cpu_utilization > ac * 2 THEN 'cpu_spike'
  WHEN execution_phase = 'error' AND 1.0 / least(n, 100) > 0.1 THEN 'error_rate_increase' END AS profile_anomaly FROM w)
"""


@query(_SMP + "SELECT event_id, state, profile_anomaly FROM s")
def execution_state(spark, sf_dir):
    return O.execution_state(O.sampling_profile(telemetry(spark, sf_dir))).select("event_id", "state", "profile_anomaly")


@query(_SMP + """SELECT event_id, round(greatest(0.01, least(1, least(1, least(1, 0.1 * CASE state WHEN 'cold_start' THEN 5 WHEN 'warm_start' THEN 2.5 WHEN 'high_latency' THEN 3 WHEN 'memory_pressure' THEN 2 WHEN 'cpu_intensive' THEN 2 ELSE 1 END
  * CASE WHEN profile_anomaly IS NOT NULL THEN 3 ELSE 1 END) * CASE WHEN n > 100 AND ac2 / n > 0.1 THEN 1.5 ELSE 1 END) * CASE WHEN n > 100 AND vd > power(ad * 0.5, 2) THEN 1.3 ELSE 1 END))::DOUBLE, 6) AS sample_rate FROM (SELECT *, count(profile_anomaly) OVER (PARTITION BY function_id ORDER BY ts_us, event_id) AS ac2 FROM s)""")
def adaptive_sample(spark, sf_dir):
    out = O.adaptive_sample(O.execution_state(O.sampling_profile(telemetry(spark, sf_dir))))
    return out.select("event_id", r("sample_rate").alias("sample_rate"))


@query(f"""WITH {TEL} SELECT function_id, count(*) AS n, round(avg(duration), 6) AS mean, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99, round(max(memory_spike_kb), 2) AS max_memory FROM tel GROUP BY 1""")
def function_profile(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    s = O.metric_summary(t, ["function_id"], "duration")
    m = t.groupBy("function_id").agg(F.max("memory_spike_kb").cast("double").alias("max_memory"))
    return s.join(m, "function_id").select("function_id", "n", *[r(c).alias(c) for c in ("mean", "p50", "p95", "p99")], F.round("max_memory", 2).alias("max_memory"))


ORACLES["function_profile"] = ORACLES["function_profile"].replace("round(max(memory_spike_kb), 2)", "round(max(memory_spike_kb)::DOUBLE, 2)")


@query("""WITH m AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE v)
SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99 FROM m GROUP BY 1""")
def metric_summary(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount").unpivot([], ["l_quantity", "l_extendedprice", "l_discount"], "metric", "value")
    return O.metric_summary(long).select("metric", "n", r("mean").alias("mean"), *[r(c, 4).alias(c) for c in ("low", "high", "p50", "p95", "p99")])


@query(f"WITH {TEL} SELECT ts_us // 60000000 AS slot, round(count(*) / 60, 6) AS ops_per_s FROM tel GROUP BY 1")
def throughput(spark, sf_dir):
    return O.throughput(telemetry(spark, sf_dir)).select("slot", r("ops_per_s").alias("ops_per_s"))


# --- preservation and privacy utility ---

def _pairs(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.select("event_id", *[F.col(c).alias("o_" + c) for c in ("execution_phase", "anomaly_type", "duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes")],
                    F.expr("CASE WHEN event_id % 5 = 0 THEN 'x' ELSE execution_phase END").alias("p_execution_phase"), F.col("anomaly_type").alias("p_anomaly_type"),
                    F.expr("duration + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1e-12 END").alias("p_duration"), F.expr("memory_spike_kb + event_id % 2").alias("p_memory_spike_kb"),
                    F.expr("cpu_utilization * 0.9D").alias("p_cpu_utilization"), F.col("network_io_bytes").alias("p_network_io_bytes"))


@query(f"""WITH {TEL}, k AS (SELECT event_id, list_filter([CASE WHEN cpu_utilization > 1e-8 THEN 'cpu_utilization' END, CASE WHEN event_id % 3 = 0 THEN 'duration' END, CASE WHEN event_id % 5 = 0 THEN 'execution_phase' END,
  CASE WHEN event_id % 2 = 1 THEN 'memory_spike_kb' END], lambda x: x IS NOT NULL) AS l FROM tel) SELECT event_id, array_to_string(l, ',') AS at_risk, round(1 - len(l) / 6.0, 4) AS preservation FROM k""")
def assess_preservation(spark, sf_dir):
    return P.assess_preservation(_pairs(spark, sf_dir)).select("event_id", F.concat_ws(",", "at_risk").alias("at_risk"), "preservation")


@query(f"""WITH {TEL}, k AS (SELECT event_id, (CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 3 = 0 THEN 1 - 1 / (duration + 1) ELSE 1 - (duration + 1e-12 - duration) / (duration + 1e-12) END + CASE WHEN event_id % 2 = 1 THEN 1 - 1 / (memory_spike_kb + 1) ELSE 1 END
   + CASE WHEN cpu_utilization = 0 THEN 1 ELSE 0.9 END) / 4 AS s FROM tel) SELECT event_id, round(s, 6) AS similarity, CASE WHEN s >= 0.95 THEN 'excellent' WHEN s >= 0.8 THEN 'good' WHEN s >= 0.6 THEN 'moderate' WHEN s >= 0.4 THEN 'poor' WHEN s >= 0.2 THEN 'critical' ELSE 'lost' END AS level FROM k""")
def transform_impact(spark, sf_dir):
    out = P.transform_impact(_pairs(spark, sf_dir), ["execution_phase", "duration", "memory_spike_kb", "cpu_utilization"])
    return out.select("event_id", r("similarity").alias("similarity"), "level")


@query(f"""WITH {TEL}, u AS (SELECT 'duration' AS field, duration AS v, 1 AS o FROM tel UNION ALL SELECT 'duration', duration + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1e-12 END, 0 FROM tel
  UNION ALL SELECT 'cpu_utilization', cpu_utilization, 1 FROM tel UNION ALL SELECT 'cpu_utilization', cpu_utilization * 0.9, 0 FROM tel),
g AS (SELECT field, v, sum(o) AS a, sum(1 - o) AS b FROM u GROUP BY 1, 2), n AS (SELECT *, sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p AS d, lead(v) OVER w - v AS wd, max(v) OVER p - min(v) OVER p AS rg FROM g
  WINDOW w AS (PARTITION BY field ORDER BY v), p AS (PARTITION BY field))
SELECT field, round(max(abs(d)), 6) AS ks, round(sum(abs(d) * coalesce(wd, 0)) / any_value(rg), 6) AS emd FROM n GROUP BY 1""")
def distribution_shift(spark, sf_dir):
    return P.distribution_shift(_pairs(spark, sf_dir), ["duration", "cpu_utilization"]).select("field", r("ks").alias("ks"), r("emd").alias("emd"))


_BOTH = f"""{TEL}, k AS (SELECT duration AS o1, duration + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1e-12 END AS p1, memory_spike_kb::DOUBLE AS o2, (memory_spike_kb + event_id % 2)::DOUBLE AS p2, cpu_utilization AS o3, cpu_utilization * 0.9::DOUBLE AS p3,
  execution_phase AS o4, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE execution_phase END AS p4 FROM tel)"""
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, o{i} AS o, p{i} AS p FROM k" for i, f in ((1, "duration"), (2, "memory_spike_kb"), (3, "cpu_utilization")))
_FID = "greatest(0, 1 - abs({a} - {b}) / (abs({a}) + 1e-10))"


@query(f"""WITH {_BOTH}, l AS ({_LONG}), m AS (SELECT field, avg(o) AS om, avg(p) AS pm, var_pop(o) AS ov, var_pop(p) AS pv, max(o) - min(o) AS rg FROM l GROUP BY 1),
h AS (SELECT field, avg(power(o - om, 3)) / power(any_value(ov), 1.5) AS os, avg(power(p - pm, 3)) / power(any_value(pv), 1.5) AS ps, avg(power(o - om, 4)) / power(any_value(ov), 2) - 3 AS ok, avg(power(p - pm, 4)) / power(any_value(pv), 2) - 3 AS pk FROM l JOIN m USING (field) GROUP BY 1),
q AS (SELECT field, unnest(quantile_cont(o, [0.1, 0.25, 0.5, 0.75, 0.9])) AS a, unnest(quantile_cont(p, [0.1, 0.25, 0.5, 0.75, 0.9])) AS b FROM l GROUP BY 1), qq AS (SELECT field, avg({_FID.format(a='a', b='b')}) AS quantiles FROM q GROUP BY 1),
u AS (SELECT field, o AS v, 1 AS x FROM l UNION ALL SELECT field, p, 0 FROM l), g AS (SELECT field, v, sum(x) AS a, sum(1 - x) AS b FROM u GROUP BY 1, 2),
n AS (SELECT *, sum(a) OVER w / sum(a) OVER f - sum(b) OVER w / sum(b) OVER f AS d, lead(v) OVER w - v AS wd FROM g WINDOW w AS (PARTITION BY field ORDER BY v), f AS (PARTITION BY field)),
e AS (SELECT field, max(abs(d)) AS ks, sum(abs(d) * coalesce(wd, 0)) AS emd FROM n GROUP BY 1),
r AS (SELECT field, {_FID.format(a='om', b='pm')} AS mean, {_FID.format(a='ov', b='pv')} AS variance, {_FID.format(a='os', b='ps')} AS skewness, {_FID.format(a='ok', b='pk')} AS kurtosis, 1 - ks AS ks, greatest(0, 1 - emd / (rg + 1e-10)) AS emd, quantiles
  FROM m JOIN h USING (field) JOIN qq USING (field) JOIN e USING (field))
SELECT field, {", ".join(f"round({c}::DOUBLE, 5) AS {c}" for c in ("mean", "variance", "skewness", "kurtosis", "ks", "emd", "quantiles"))}, round(((mean + variance + skewness + kurtosis + ks + emd + quantiles) / 7)::DOUBLE, 5) AS overall FROM r""")
def distribution_fidelity(spark, sf_dir):
    out = P.distribution_fidelity(_pairs(spark, sf_dir), ["duration", "memory_spike_kb", "cpu_utilization"])
    return out.select("field", *[r(c, 5).alias(c) for c in out.columns[1:]])


@query(f"""WITH {_BOTH}, l AS (SELECT 'execution_phase' AS field, (length(o4) / greatest(length(o4), 1) * least(length(o4), length(p4)) / greatest(length(o4), length(p4)) + 1) / 2 AS s, 1.0::DOUBLE AS t FROM k
  UNION ALL SELECT 'duration', CASE WHEN o1 <> 0 THEN greatest(0, 1 - abs(o1 - p1) / abs(o1)) WHEN p1 = 0 THEN 1 ELSE 0.5 END, 1.0 FROM k
  UNION ALL SELECT 'memory_spike_kb', CASE WHEN o2 <> 0 THEN greatest(0, 1 - abs(o2 - p2) / abs(o2)) WHEN p2 = 0 THEN 1 ELSE 0.5 END, 1.0 FROM k
  UNION ALL SELECT 'cpu_utilization', CASE WHEN o3 <> 0 THEN greatest(0, 1 - abs(o3 - p3) / abs(o3)) WHEN p3 = 0 THEN 1 ELSE 0.5 END, 1.0 FROM k)
SELECT field, 1.0::DOUBLE AS presence, any_value(t) AS type_kept, round(avg(s)::DOUBLE, 6) AS pattern FROM l GROUP BY 1""")
def pattern_fidelity(spark, sf_dir):
    out = P.pattern_fidelity(_pairs(spark, sf_dir), ["execution_phase", "duration", "memory_spike_kb", "cpu_utilization"])
    return out.select("field", "presence", "type_kept", r("pattern").alias("pattern"))


@query(f"""WITH {_BOTH}, l AS ({_LONG}), rk AS (SELECT field, rank() OVER (PARTITION BY field ORDER BY o) + (count(*) OVER (PARTITION BY field, o) - 1) / 2.0 AS a, rank() OVER (PARTITION BY field ORDER BY p) + (count(*) OVER (PARTITION BY field, p) - 1) / 2.0 AS b FROM l),
c AS (SELECT unnest([corr(o1, o2), corr(o1, o3), corr(o2, o3)]) AS x, unnest([corr(p1, p2), corr(p1, p3), corr(p2, p3)]) AS y FROM k), s AS (SELECT greatest(0, corr(x, y)) AS structure, greatest(0, 1 - 2 * sum(abs(x - y)) / 9) AS fidelity FROM c)
SELECT field, round(greatest(0, corr(a, b)), 6) AS rank_correlation, any_value(round(structure, 6)) AS structure, any_value(round(fidelity, 6)) AS fidelity FROM rk, s GROUP BY 1""")
def correlation_fidelity(spark, sf_dir):
    structure, ranks = P.correlation_fidelity(_pairs(spark, sf_dir), ["duration", "memory_spike_kb", "cpu_utilization"])
    return ranks.crossJoin(F.broadcast(structure)).select("field", *[r(c).alias(c) for c in ("rank_correlation", "structure", "fidelity")])  # one row


@query(f"""WITH {TEL}, k AS (SELECT *, duration + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1e-12 END AS pd, cpu_utilization * 0.9 AS pc FROM tel)
SELECT 'duration' AS field, round(greatest(0, 1 - abs(avg(duration) - avg(pd)) / avg(duration)), 6) AS mean_kept, round(greatest(0, 1 - abs(var_pop(duration) - var_pop(pd)) / var_pop(duration)), 6) AS variance_kept, round(abs(corr(duration, pd)), 6) AS correlation_kept FROM k
UNION ALL SELECT 'cpu_utilization', round(greatest(0, 1 - abs(avg(cpu_utilization) - avg(pc)) / avg(cpu_utilization)), 6), round(greatest(0, 1 - abs(var_pop(cpu_utilization) - var_pop(pc)) / var_pop(cpu_utilization)), 6), round(abs(corr(cpu_utilization, pc)), 6) FROM k""")
def utility_metrics(spark, sf_dir):
    return P.utility_metrics(_pairs(spark, sf_dir), ["duration", "cpu_utilization"]).select("field", *[r(c).alias(c) for c in ("mean_kept", "variance_kept", "correlation_kept")])


@query(f"""WITH {TEL}, u AS (SELECT 'anomaly_type' AS field, anomaly_type AS v FROM tel UNION ALL SELECT 'execution_phase', execution_phase FROM tel UNION ALL SELECT 'function_id', function_id FROM tel), k AS (SELECT field, v, count(*) AS n FROM u GROUP BY 1, 2)
SELECT field, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM k GROUP BY 1""")
def field_entropy(spark, sf_dir):
    return P.field_entropy(telemetry(spark, sf_dir), ["anomaly_type", "execution_phase", "function_id"]).select("field", r("entropy").alias("entropy"))


@query(f"""WITH {TEL}, ab AS (SELECT anomaly_type a, execution_phase b, count(*) n FROM tel GROUP BY 1, 2), a AS (SELECT a, sum(n) n FROM ab GROUP BY 1), b AS (SELECT b, sum(n) n FROM ab GROUP BY 1)
SELECT round((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM a) + (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM b) - (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM ab), 6) AS mutual_information""")
def mutual_information(spark, sf_dir):
    return P.mutual_information(telemetry(spark, sf_dir), "anomaly_type", "execution_phase").select(r("mutual_information").alias("mutual_information"))


@query(f"""WITH {TEL} SELECT 'duration' AS a, 'cpu_utilization' AS b, round(corr(duration, cpu_utilization), 6) AS corr FROM tel UNION ALL SELECT 'duration', 'memory_spike_kb', round(corr(duration, memory_spike_kb), 6) FROM tel
UNION ALL SELECT 'cpu_utilization', 'memory_spike_kb', round(corr(cpu_utilization, memory_spike_kb), 6) FROM tel""")
def correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(telemetry(spark, sf_dir), ["duration", "cpu_utilization", "memory_spike_kb"]).select("a", "b", r("corr").alias("corr"))


@query(f"""WITH {TEL}, u AS (UNPIVOT (SELECT duration, cpu_utilization FROM tel) ON duration, cpu_utilization INTO NAME field VALUE v), q AS (SELECT field, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.5) AS p50 FROM u GROUP BY 1),
m AS (SELECT field, avg(v) AS mu, var_pop(v) AS va FROM u GROUP BY 1)
SELECT field, round(any_value(mu), 6) AS mean, round(any_value(va), 4) AS variance, round(avg(power(v - mu, 3)) / power(any_value(va), 1.5), 5) AS skewness, round(avg(power(v - mu, 4)) / power(any_value(va), 2) - 3, 5) AS kurtosis, round(any_value(p5), 6) AS p5, round(any_value(p50), 6) AS p50,
  round(avg(CAST(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS INT)), 6) AS outlier_ratio FROM u JOIN q USING (field) JOIN m USING (field) GROUP BY field""")
def distribution_profile(spark, sf_dir):
    out = P.distribution_profile(telemetry(spark, sf_dir), ["duration", "cpu_utilization"])
    return out.select("field", r("mean").alias("mean"), r("variance", 4).alias("variance"), r("skewness", 5).alias("skewness"), r("kurtosis", 5).alias("kurtosis"), r("p5").alias("p5"), r("p50").alias("p50"), r("outlier_ratio").alias("outlier_ratio"))


@query(f"""WITH {TEL}, u AS (SELECT function_id AS budget_id, CASE WHEN event_id % 2 = 0 THEN 'laplace' ELSE 'gaussian' END AS mechanism, duration / 1000 AS eps FROM tel), k AS (SELECT budget_id, mechanism, count(*) AS uses, sum(eps) AS e FROM u GROUP BY 1, 2)
SELECT budget_id, mechanism, uses, round(e, 6) AS epsilon, round(greatest(0, 0.5 - sum(e) OVER (PARTITION BY budget_id)), 6) AS remaining, sum(e) OVER (PARTITION BY budget_id) >= 0.5 AS exhausted FROM k""")
def privacy_budget_ledger(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(F.col("function_id").alias("budget_id"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'laplace' ELSE 'gaussian' END").alias("mechanism"), (F.col("duration") / 1000).alias("epsilon"), F.lit(1e-6).alias("delta"))
    return P.budget_ledger(t, 0.5).select("budget_id", "mechanism", "uses", r("epsilon").alias("epsilon"), r("remaining").alias("remaining"), "exhausted")


@query(None)
def add_noise(spark, sf_dir):
    """Utility of noisy durations: seeded noise, so only its effect on whole columns is reported."""
    t = telemetry(spark, sf_dir)
    noisy = P.add_noise(P.add_noise(t, "duration", 1.0, out="p_duration"), "cpu_utilization", 1.0, "gaussian", out="p_cpu_utilization")
    return P.utility_metrics(noisy.withColumnsRenamed({"duration": "o_duration", "cpu_utilization": "o_cpu_utilization"}), ["duration", "cpu_utilization"])


@query(None)
def behavioural_features(spark, sf_dir):
    return P.behavioural_features(telemetry(spark, sf_dir)).select("event_id", "behavioural_signature", F.size("behavioural_features").alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def price_quantiles(spark, sf_dir):
    """Exact percentiles of large groups by sketch bands."""
    q = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.99])
    return q.groupBy("l_returnflag").agg(*[r(F.max(F.when(F.col("p") == p, F.col("q"))), 4).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.99)])
