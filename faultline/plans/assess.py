"""Queries of evaluation, rollups, trace properties and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import evaluation as V, layers, records, rollups as R, traces as T
from faultline.plans.common import TEL, Query, r
from faultline.plans.pipeline import _L3, AT
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


_SC = f"""WITH {TEL}, s AS (SELECT event_id, function_id, anomaly_type, anomaly_type <> 'benign' AS label,
  round(least(1, duration / 40 + cpu_utilization / 400 + CASE WHEN execution_phase = 'error' THEN 0.3 ELSE 0 END + CASE WHEN anomaly_type = 'memory_spike' THEN 0.1 ELSE 0 END) + 1e-9, 3)::DOUBLE AS score FROM tel)
"""


def _scores(spark, sf_dir):
    score = F.expr("""least(1D, duration / 40 + cpu_utilization / 400 + CASE WHEN execution_phase = 'error' THEN 0.3D ELSE 0D END + CASE WHEN anomaly_type = 'memory_spike' THEN 0.1D ELSE 0D END)""")
    return telemetry(spark, sf_dir).select("event_id", "function_id", "anomaly_type", (F.col("anomaly_type") != "benign").alias("label"), F.round(score + 1e-9, 3).alias("score"))


_CM = """count(*) FILTER (WHERE label AND {p}) AS tp, count(*) FILTER (WHERE NOT label AND {p}) AS fp, count(*) FILTER (WHERE label AND NOT {p}) AS fn, count(*) FILTER (WHERE NOT label AND NOT {p}) AS tn"""
_RT = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_P3 = ["precision", "recall", "f1"]


@query(_SC + f", c AS (SELECT function_id, {_CM.format(p='score >= 0.4')} FROM s GROUP BY 1) SELECT function_id, tp, fp, fn, tn, {_RT}, round(fp / (fp + tn), 6) AS fpr FROM c")
def confusion_metrics(spark, sf_dir):
    out = V.confusion_metrics(_scores(spark, sf_dir), "label", F.col("score") >= 0.4, ["function_id"])
    return out.select("function_id", "tp", "fp", "fn", "tn", *[r(c).alias(c) for c in [*_P3, "fpr"]])


_AUC = """a AS (SELECT function_id, (sum(rk) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2) / (count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label)) AS auc
  FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY function_id, score) - 1) / 2.0 AS rk FROM s WINDOW w AS (PARTITION BY function_id ORDER BY score)) GROUP BY 1)"""


@query(_SC + ", " + _AUC + " SELECT function_id, round(auc, 6) AS auc FROM a")
def roc_auc(spark, sf_dir):
    return V.roc_auc(_scores(spark, sf_dir), "label", "score", ["function_id"]).select("function_id", r("auc").alias("auc"))


_CV = _SC + """, d AS (SELECT score AS threshold, count(*) FILTER (WHERE label) AS pos, count(*) FILTER (WHERE NOT label) AS neg FROM s GROUP BY 1),
c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM d WINDOW w AS (ORDER BY threshold DESC)),
k AS (SELECT *, tp / (tp + fp) AS p, tp / pa AS rc, fp / na AS fpr, 2 * tp / (tp + fp + pa) AS f1 FROM c)
"""


@query(_CV + "SELECT threshold, tp, fp, round(p, 6) AS precision, round(rc, 6) AS recall, round(fpr, 6) AS fpr FROM k")
def curve_points(spark, sf_dir):
    out = V.curve_points(_scores(spark, sf_dir), "label", "score")
    return out.select("threshold", "tp", "fp", r("precision").alias("precision"), r("recall").alias("recall"), r("fpr").alias("fpr"))


@query(_CV + """SELECT round(sum(p * pos / pa), 6) AS average_precision, arg_max(threshold, (round(f1, 12), threshold)) AS best_threshold, round(max(f1), 6) AS best_f1,
  max(threshold) FILTER (WHERE fpr >= 0.01) AS at_fpr_01, max(threshold) FILTER (WHERE fpr >= 0.05) AS at_fpr_05, max(threshold) FILTER (WHERE fpr >= 0.1) AS at_fpr_10 FROM k""")
def curve_summary(spark, sf_dir):
    out = V.curve_summary(_scores(spark, sf_dir), "label", "score")
    return out.select(r("average_precision").alias("average_precision"), "best_threshold", r("best_f1").alias("best_f1"), "at_fpr_01", "at_fpr_05", "at_fpr_10")


_SW = _SC + f""", t AS (SELECT round(0.1 + i * 0.05, 2)::DOUBLE AS threshold FROM range(17) x(i)), c AS (SELECT threshold, {_CM.format(p='score >= threshold')} FROM s, t GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS ff, fp / (fp + tn) AS fpr FROM c)
"""


@query(_SW + f"SELECT threshold, tp, fp, fn, tn, {_RT} FROM c")
def threshold_sweep(spark, sf_dir):
    out = V.threshold_sweep(_scores(spark, sf_dir), "label", "score", V.sweep_thresholds())
    return out.select("threshold", "tp", "fp", "fn", "tn", *[r(c).alias(c) for c in _P3])


@query(_SW + "SELECT threshold, round(p, 6) AS precision, round(rc, 6) AS recall, round(ff, 6) AS f1 FROM m ORDER BY round(ff, 6) DESC, round(rc, 6) DESC, threshold DESC LIMIT 1")
def pick_threshold(spark, sf_dir):
    return V.pick_threshold(V.threshold_sweep(_scores(spark, sf_dir), "label", "score", V.sweep_thresholds()))


@query(_SC + f""", t AS (SELECT round(0.05 + i * 0.01, 2)::DOUBLE AS threshold FROM range(91) x(i)), c AS (SELECT threshold, {_CM.format(p='score >= threshold')} FROM s, t GROUP BY 1)
SELECT threshold, {_RT} FROM c ORDER BY f1 DESC, threshold LIMIT 1""")
def grid_search_threshold(spark, sf_dir):
    sweep = V.threshold_sweep(_scores(spark, sf_dir), "label", "score", V.sweep_thresholds(0.01, 0.05, 91))
    return V.pick_threshold(sweep, "first_best")


_BC = _SW.rstrip() + """, k AS (SELECT *, fpr * 100 + (1 - rc) * 10 * 10000 / 365 AS cost, fpr <= 0.05 AND rc >= 0.9 AS ok FROM m),
z AS (SELECT * FROM k ORDER BY CASE WHEN (SELECT bool_or(ok) FROM k) THEN CASE WHEN ok THEN round(ff - cost / 1000, 9) END ELSE -round(cost, 9) END DESC NULLS LAST, threshold LIMIT 1)
"""


@query(_BC + "SELECT CASE WHEN (SELECT bool_or(ok) FROM k) THEN 'optimal_found' ELSE 'best_compromise' END AS status, threshold, round(ff, 6) AS f1, round(cost, 4) AS daily_cost FROM z")
def threshold_by_cost(spark, sf_dir):
    out = V.threshold_by_cost(V.threshold_sweep(_scores(spark, sf_dir), "label", "score", V.sweep_thresholds()))
    return out.select("status", "threshold", r("f1").alias("f1"), r("daily_cost", 4).alias("daily_cost"))


@query(_BC + """, b AS (SELECT threshold, rc * 50 AS prevented, rc * 50 * 25000 AS benefit, 50000 + fpr * 36500 AS cost FROM z)
SELECT threshold, round(benefit, 4) AS benefit, round(cost, 4) AS cost, round((benefit - cost) / cost * 100, 6) AS roi_percent, round(cost / greatest(prevented, 1), 6) AS break_even_attack_cost, round((0.5 * benefit - cost) / cost * 100, 6) AS roi_half_attacks,
  CASE WHEN (benefit - cost) / cost > 5 THEN 'low' WHEN (benefit - cost) / cost > 2 THEN 'medium' ELSE 'high' END AS risk FROM b""")
def cost_benefit(spark, sf_dir):
    chosen = V.threshold_by_cost(V.threshold_sweep(_scores(spark, sf_dir), "label", "score", V.sweep_thresholds()))
    return V.cost_benefit(chosen).select("threshold", r("benefit", 4).alias("benefit"), r("cost", 4).alias("cost"), *[r(c).alias(c) for c in ("roi_percent", "break_even_attack_cost", "roi_half_attacks")], "risk")


@query(_SC + """SELECT count(*) FILTER (WHERE NOT label) AS benign_n, round(avg(score) FILTER (WHERE NOT label), 6) AS benign_mean, count(*) FILTER (WHERE label) AS anomaly_n, round(avg(score) FILTER (WHERE label), 6) AS anomaly_mean,
  round(min(score) FILTER (WHERE label) - max(score) FILTER (WHERE NOT label), 6) AS gap FROM s""")
def score_gap(spark, sf_dir):
    out = V.score_gap(_scores(spark, sf_dir), "label", "score")
    return out.select("benign_n", r("benign_mean").alias("benign_mean"), "anomaly_n", r("anomaly_mean").alias("anomaly_mean"), r("gap").alias("gap"))


@query(_SC + f", c AS (SELECT {_CM.format(p='score >= 0.35')} FROM s) SELECT tp, fp, fn, tn, {_RT}, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_rate FROM c")
def apply_threshold(spark, sf_dir):
    out = V.apply_threshold(_scores(spark, sf_dir), "label", "score", 0.35)
    return out.select("tp", "fp", "fn", "tn", *[r(c).alias(c) for c in [*_P3, "predicted_rate"]])


@query(_SC + f", c AS (SELECT anomaly_type, avg(score) AS ms, {_CM.format(p='score >= 0.35')} FROM s GROUP BY 1) SELECT anomaly_type, tp, fp, fn, {_RT}, round(ms, 6) AS mean_score FROM c")
def metrics_by_attack_type(spark, sf_dir):
    s = _scores(spark, sf_dir)
    out = V.confusion_metrics(s, "label", F.col("score") >= 0.35, ["anomaly_type"]).join(s.groupBy("anomaly_type").agg(F.avg("score").alias("mean_score")), "anomaly_type")
    return out.select("anomaly_type", "tp", "fp", "fn", *[r(c).alias(c) for c in [*_P3, "mean_score"]])


@query(_SC + """SELECT label, fold, CAST(n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT label, count(*) AS n FROM s GROUP BY 1), (SELECT CAST(unnest(range(5)) AS INT) AS fold)""")
def stratified_kfold(spark, sf_dir):
    return V.stratified_kfold(_scores(spark, sf_dir), "label", "event_id").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(_SC + """, n AS (SELECT count(*) FILTER (WHERE NOT label) AS b, count(*) FILTER (WHERE label) AS a FROM s)
SELECT 'train' AS part, false AS label, CAST(floor(b * 0.8) AS BIGINT) AS n FROM n UNION ALL SELECT 'test', false, CAST(b - floor(b * 0.8) AS BIGINT) FROM n UNION ALL SELECT 'test', true, a FROM n""")
def benign_split(spark, sf_dir):
    return V.benign_split(_scores(spark, sf_dir), "label", "event_id").groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


_CMP = _SC + """, p AS (SELECT event_id, score AS a, round(CAST((cpu_utilization / 101)::VARCHAR AS DECIMAL(24, 18)), 3)::DOUBLE AS b FROM s JOIN tel USING (event_id)),
g AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, var_samp(a) AS sa, var_samp(b) AS sb FROM p),
u AS (SELECT a AS v, 1 AS x FROM p UNION ALL SELECT b, 0 FROM p), k AS (SELECT v, sum(x) AS x, sum(1 - x) AS y FROM u GROUP BY 1),
kk AS (SELECT *, coalesce(sum(y) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS yb, sum(y) OVER () AS ya FROM k),
uu AS (SELECT sum(x * (yb + y / 2.0)) AS u, sum(x * yb) AS more, sum(x * (ya - yb - y)) AS less FROM kk),
d AS (SELECT abs(a - b) AS v, a > b AS up FROM p WHERE a - b <> 0), rk AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM d),
w AS (SELECT least(sum(rk) FILTER (WHERE up), sum(rk) FILTER (WHERE NOT up)) AS w FROM rk)
"""


@query(_CMP + """SELECT n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round((ma - mb) / sqrt((va + vb) / 2), 6) AS cohens_d, round((ma - mb) / sqrt((sa + sb) / n), 4) AS t, round(u::DOUBLE, 1) AS u, round(w::DOUBLE, 1) AS w,
  round((less - more) / (n::DOUBLE * n), 6) AS cliffs_delta, round(ma - mb - 1.96 * sqrt(va / n + vb / n), 6) AS ci_low, round(ma - mb + 1.96 * sqrt(va / n + vb / n), 6) AS ci_high FROM g, uu, w""")
def compare_scores(spark, sf_dir):
    s = _scores(spark, sf_dir).join(telemetry(spark, sf_dir).select("event_id", F.round(F.col("cpu_utilization") / 101, 3).alias("b")), "event_id")
    out = V.compare_scores(s.withColumnRenamed("score", "a"), "a", "b")
    return out.select("n", r("mean_a").alias("mean_a"), r("mean_b").alias("mean_b"), r("cohens_d").alias("cohens_d"), r("t", 4).alias("t"), r("u", 1).alias("u"), r("w", 1).alias("w"),
                      r("cliffs_delta").alias("cliffs_delta"), r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"))


@query(f"""WITH {TEL}, n AS (SELECT count(*) AS n FROM tel), q AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p),
v AS (SELECT list(duration ORDER BY duration) AS l FROM tel), b AS (SELECT p, p * (n - 1) AS a, (p - 1.96 * sqrt(p * (1 - p) / n)) * (n - 1) AS lo, least(1, p + 1.96 * sqrt(p * (1 - p) / n)) * (n - 1) AS hi FROM q, n)
SELECT p, round(l[CAST(floor(a) AS BIGINT) + 1] + (l[CAST(ceil(a) AS BIGINT) + 1] - l[CAST(floor(a) AS BIGINT) + 1]) * (a - floor(a)), 6) AS estimate,
  round(l[CAST(floor(lo) AS BIGINT) + 1] + (l[CAST(ceil(lo) AS BIGINT) + 1] - l[CAST(floor(lo) AS BIGINT) + 1]) * (lo - floor(lo)), 6) AS low,
  round(l[CAST(floor(hi) AS BIGINT) + 1] + (l[CAST(ceil(hi) AS BIGINT) + 1] - l[CAST(floor(hi) AS BIGINT) + 1]) * (hi - floor(hi)), 6) AS high FROM b, v""")
def percentile_ci(spark, sf_dir):
    return V.percentile_ci(telemetry(spark, sf_dir), "duration").select("p", r("estimate").alias("estimate"), r("low").alias("low"), r("high").alias("high"))


@query(f"""WITH {TEL}, a AS (SELECT avg(duration) AS x FROM tel WHERE event_id % 2 = 0), b AS (SELECT avg(duration) AS y FROM tel WHERE event_id % 2 = 1)
SELECT round(y - x, 6) AS absolute, round((y - x) / x * 100, 6) AS relative_percent FROM a, b""")
def latency_overhead(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    out = V.latency_overhead(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), "duration")
    return out.select(r("absolute").alias("absolute"), r("relative_percent").alias("relative_percent"))


# --- rollups over the decisions of the canonical layers ---

_DET = _L3 + """, det AS (SELECT *, CASE WHEN anomaly_type LIKE '%timeout%' THEN 'impact' WHEN anomaly_type LIKE '%exfil%' THEN 'exfiltration' WHEN anomaly_type LIKE '%spike%' THEN 'discovery' ELSE 'collection' END AS tactic,
  CASE WHEN anomaly_type LIKE '%timeout%' THEN 'service-degradation' WHEN anomaly_type LIKE '%exfil%' THEN 'automated-exfiltration' WHEN anomaly_type LIKE '%spike%' THEN 'cloud-service-discovery' ELSE 'telemetry-observation' END AS technique FROM p)
"""


def _detections(spark, sf_dir):
    return layers.run_pipeline(scored_telemetry(spark, sf_dir), AT, label="anomaly_type").select("event_id", "function_id", "ts_us", "anomaly_type", "decision", "fused_score", "tactics", "techniques")


def _cases(spark, sf_dir):
    return telemetry(spark, sf_dir).where("anomaly_type <> 'benign'").select("event_id", F.expr("event_id % 37").alias("case_id"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'closed' END").alias("status"))


@query(_DET + "SELECT function_id, count(*) AS total, count(*) FILTER (WHERE decision = 'observe') AS observe, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'escalate') AS escalate, max(ts_us) AS last_seen FROM det GROUP BY 1")
def function_rollup(spark, sf_dir):
    return R.function_rollup(_detections(spark, sf_dir))


@query(_DET + "SELECT function_id, technique, count(*) AS hits FROM det GROUP BY 1, 2")
def function_techniques(spark, sf_dir):
    return R.technique_counts(_detections(spark, sf_dir), ("function_id",))


@query(_DET + "SELECT function_id, event_id, decision, CAST(row_number() OVER (PARTITION BY function_id ORDER BY ts_us DESC, event_id DESC) AS INT) AS position FROM det QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY ts_us DESC, event_id DESC) <= 5")
def recent_detections(spark, sf_dir):
    return R.recent_detections(_detections(spark, sf_dir)).select("function_id", "event_id", "decision", "position")


@query(_DET + """SELECT b AS bucket_start, count(event_id) AS n FROM (SELECT unnest(range(0, 24)) * 3600000000 AS b) LEFT JOIN det ON ts_us // 3600000000 * 3600000000 = b AND decision <> 'observe' GROUP BY 1""")
def detection_histogram(spark, sf_dir):
    return R.histogram(_detections(spark, sf_dir).where("decision <> 'observe'"), 0, 86_400_000_000)


@query(_DET + "SELECT tactic, technique, count(*) AS hits FROM det GROUP BY ROLLUP (tactic, technique)")
def threat_map(spark, sf_dir):
    return R.threat_map(_detections(spark, sf_dir))


@query(_DET + """SELECT 'severity' AS kind, decision AS name, count(*) AS n FROM det GROUP BY decision UNION ALL SELECT 'technique', technique, count(*) FROM det GROUP BY technique
UNION ALL SELECT 'case_status', CASE WHEN anomaly_type = 'benign' THEN 'none' WHEN event_id % 2 = 0 THEN 'open' ELSE 'closed' END, count(*) FROM det GROUP BY 2""")
def inbox_summary(spark, sf_dir):
    return R.inbox_summary(_detections(spark, sf_dir), _cases(spark, sf_dir))


@query(_DET + """SELECT event_id % 37 AS case_id, count(*) AS detections, CASE max(CASE decision WHEN 'escalate' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) WHEN 2 THEN 'escalate' WHEN 1 THEN 'review' ELSE 'observe' END AS max_severity
FROM det WHERE anomaly_type <> 'benign' GROUP BY 1""")
def case_rollup(spark, sf_dir):
    return R.case_rollup(_cases(spark, sf_dir), _detections(spark, sf_dir))


@query("""SELECT c_custkey, coalesce(k.n, 0) AS num_metrics, coalesce(m.n, 0) AS num_models, m.b AS best_score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) k ON k.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) m ON m.o_custkey = c_custkey""")
def experiment_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = R.experiment_summary(table(spark, sf_dir, "customer").select("c_custkey"), o, o.where("o_orderstatus = 'F'"), "c_custkey", "o_totalprice")
    return out.select("c_custkey", "num_metrics", "num_models", "best_score")


@query("SELECT l_returnflag, count(*) AS num_experiments, round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, round(stddev_samp(l_quantity), 6) AS std_l_quantity FROM lineitem GROUP BY 1")
def model_comparison(spark, sf_dir):
    out = R.model_comparison(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", "num_experiments", r("avg_l_quantity").alias("avg_l_quantity"), r("avg_l_extendedprice", 4).alias("avg_l_extendedprice"), r("std_l_quantity").alias("std_l_quantity"))


# --- trace properties: a trace is one user's events ---

_TR = f"""WITH {TEL}, h AS (SELECT tel.*, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, tel.event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM tel JOIN events USING (event_id)),
b AS (SELECT *, duration > 0 AS complete, execution_phase = 'error' OR anomaly_type IN ('execution_failure','timeout_fallback') AS error, execution_phase = 'init' AS cold, anomaly_type = 'timeout_fallback' AS timeout, memory_spike_kb > 102400 AS highmem,
  duration > 10 AS highdur, duration < 5 AS resp, memory_spike_kb / 1024.0 < 512 AS under FROM h),
g AS (SELECT user_id, bool_or(complete) AS p1, NOT bool_and(error) AS p2, NOT bool_or(cold AND rn = 1) OR bool_or(NOT cold) AS p3, bool_and(under) AS p4, true AS p5, bool_and(NOT (error AND complete)) AS p6, NOT bool_or(error AND rn = 1) OR bool_or(resp) AS p7,
  NOT bool_or(timeout AND rn = 1) OR bool_or(complete OR error) AS p8, NOT bool_and(error) OR bool_or(timeout) AS p9, NOT bool_or(highmem AND rn = 1) OR bool_or(NOT highmem) AS p10, bool_or(resp AND rn = n) AS p11, bool_or(NOT highdur AND rn = n) AS p12,
  min(CASE WHEN NOT under THEN rn - 1 END) AS c4, min(CASE WHEN error AND complete THEN rn - 1 END) AS c6 FROM b GROUP BY 1),
v AS (SELECT user_id, unnest([{{'p': 'eventual_completion', 't': 'completeness', 's': p1, 'c': NULL::BIGINT}}, {{'p': 'no_infinite_errors', 't': 'liveness', 's': p2, 'c': NULL}}, {{'p': 'cold_start_warmup', 't': 'liveness', 's': p3, 'c': NULL}},
  {{'p': 'memory_bounds', 't': 'safety', 's': p4, 'c': c4}}, {{'p': 'no_simultaneous_states', 't': 'safety', 's': p5, 'c': NULL}}, {{'p': 'error_implies_no_completion', 't': 'safety', 's': p6, 'c': c6}}, {{'p': 'eventual_response', 't': 'liveness', 's': p7, 'c': NULL}},
  {{'p': 'timeout_recovery', 't': 'liveness', 's': p8, 'c': NULL}}, {{'p': 'error_before_timeout', 't': 'causality', 's': p9, 'c': NULL}}, {{'p': 'memory_spike_completion', 't': 'causality', 's': p10, 'c': NULL}},
  {{'p': 'infinite_responsiveness', 't': 'liveness', 's': p11, 'c': NULL}}, {{'p': 'bounded_duration', 't': 'fairness', 's': p12, 'c': NULL}}]) AS x FROM g)
"""


def _by_user(spark, sf_dir):
    return telemetry(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")


@query(_TR + "SELECT user_id, x.p AS property, x.t AS type, x.s AS satisfied, x.c AS counterexample FROM v")
def verify_traces(spark, sf_dir):
    return T.verify_traces(_by_user(spark, sf_dir), "user_id")


@query(_TR + "SELECT x.p AS property, x.t AS type, count(*) AS traces, count(*) FILTER (WHERE x.s) AS satisfied, round(avg(CAST(x.s AS INT)), 6) AS rate FROM v GROUP BY 1, 2")
def verify_dataset(spark, sf_dir):
    return T.verify_dataset(_by_user(spark, sf_dir), "user_id").withColumn("rate", r("rate"))


@query(_TR + """SELECT user_id, coalesce(bool_or(resp AND rn = 2), false) AS next_responsive, coalesce(min(CASE WHEN error THEN rn END) <= coalesce(min(CASE WHEN NOT (duration < 20) THEN rn END), 4611686018427387904), false) AS short_until_error, bool_or(highmem) AS some_high_memory FROM b GROUP BY 1""")
def check_formula(spark, sf_dir):
    at = F.col("_pos")
    return T.check_formula(_by_user(spark, sf_dir), "user_id", {
        "next_responsive": T.next_state(T.PREDICATES["responsive"], at), "short_until_error": T.until("duration < 20", T.PREDICATES["error"]), "some_high_memory": T.eventually(T.PREDICATES["high_memory"])})


# --- integrity: a batch is one hour of a function ---

_LEAF = f"""WITH RECURSIVE {TEL}, lf AS (SELECT function_id AS fn, ts_us // 3600000000 AS hour, function_id || '/' || (ts_us // 3600000000) AS batch, row_number() OVER (PARTITION BY function_id, ts_us // 3600000000 ORDER BY ts_us, event_id) - 1 AS i,
  sha256(event_id || ':' || function_id || ':' || ts_us) AS h FROM tel), l0 AS (SELECT fn, hour, batch, list(h ORDER BY i) AS l FROM lf GROUP BY ALL),
mk AS (SELECT fn, hour, batch, l FROM l0 UNION ALL SELECT fn, hour, batch, list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], l[2 * k + 1]))) FROM mk WHERE len(l) > 1),
rt AS (SELECT fn, hour, batch, l[1] AS root FROM mk WHERE len(l) = 1)
"""


def _leaves(spark, sf_dir):
    from faultline.operators.history import index_rows
    t = telemetry(spark, sf_dir).select("event_id", "function_id", "ts_us", F.concat("function_id", F.lit("/"), F.expr("CAST(ts_us DIV 3600000000 AS STRING)")).alias("batch"))
    t = index_rows(t, ["batch"]).withColumn("i", F.col("rn") - 1)
    return t.withColumn("h", F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "function_id", F.col("ts_us").cast("string")), 256))


@query(_LEAF + "SELECT batch, root AS merkle_root FROM rt")
def merkle_root(spark, sf_dir):
    return T.merkle_roots(_leaves(spark, sf_dir), "batch", "i", "h")


@query(_LEAF + "SELECT fn, count(*) AS leaves, count(*) AS verified FROM lf GROUP BY 1")
def merkle_proof(spark, sf_dir):
    """Every leaf's proof leads to the root, and a changed leaf's would not."""
    leaves = _leaves(spark, sf_dir)
    roots = T.merkle_roots(leaves, "batch", "i", "h")
    ends = T.merkle_proofs(leaves, "batch", "i", "h").select("batch", T.proof_end(F.col("leaf"), F.col("proof")).alias("end"), T.proof_end(F.sha2("leaf", 256), F.col("proof")).alias("changed"))
    # all sound proofs of a batch end in one digest, so they are counted before they meet the root
    told = ends.groupBy("batch", "end").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("changed") != F.col("end")).alias("apart")).join(roots, "batch")
    good = F.when(F.col("end") == F.col("merkle_root"), F.col("apart")).otherwise(0)
    return told.groupBy(F.substring_index("batch", "/", 1).alias("fn")).agg(F.sum("n").alias("leaves"), F.sum(good).alias("verified"))


def _blocks(spark, sf_dir):
    roots = T.merkle_roots(_leaves(spark, sf_dir), "batch", "i", "h")
    return roots.select(F.substring_index("batch", "/", 1).alias("fn"), F.substring_index("batch", "/", -1).cast("bigint").alias("hour"), "merkle_root")


@query(_LEAF + """, o AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY hour) AS k FROM rt),
ch AS (SELECT fn, k, hour, sha256(hour || ':' || repeat('0', 64) || ':' || root) AS b FROM o WHERE k = 1 UNION ALL SELECT o.fn, o.k, o.hour, sha256(o.hour || ':' || ch.b || ':' || o.root) FROM ch JOIN o ON o.fn = ch.fn AND o.k = ch.k + 1)
SELECT fn, hour, b AS block_hash FROM ch""")
def hash_chain(spark, sf_dir):
    return T.build_chain(_blocks(spark, sf_dir), "fn", "hour", "merkle_root").select("fn", "hour", "block_hash")


@query(_LEAF + "SELECT fn, count(*) AS blocks, CASE WHEN substr(fn, 4)::INT % 4 = 0 THEN 5::BIGINT END AS first_break FROM rt GROUP BY 1")
def validate_chain(spark, sf_dir):
    """Chains with one tampered root in every fourth function."""
    chain = T.build_chain(_blocks(spark, sf_dir), "fn", "hour", "merkle_root")
    bad = (F.substring("fn", 4, 2).cast("int") % 4 == 0) & (F.col("hour") == 5)
    return T.validate_chain(chain.withColumn("merkle_root", F.when(bad, "x").otherwise(F.col("merkle_root"))), "fn", "hour", "merkle_root")


@query(f"""WITH {TEL}, x AS (SELECT *, function_id || '/' || (ts_us // 3600000000) AS batch, md5(CAST(cpu_utilization AS INT) || ':' || memory_spike_kb) AS h, lag(ts_us) OVER (PARTITION BY function_id || '/' || (ts_us // 3600000000) ORDER BY event_id) AS pt FROM tel),
s AS (SELECT batch, count(*) AS n, avg(duration) AS m, stddev_pop(duration) AS sd, count(*) - count(DISTINCT h) AS dup FROM x GROUP BY 1)
SELECT batch, any_value(n) AS records, count(*) FILTER (WHERE n > 3 AND abs(duration - m) > 3 * sd) AS duration_outlier, any_value(dup) AS duplicate_hash, count(*) FILTER (WHERE duration > 0.1 AND cpu_utilization = 0) AS impossible_cpu,
  CAST(count(*) FILTER (WHERE ts_us < pt - 60000000) > any_value(n) * 0.1 AS INT) AS disorder FROM x JOIN s USING (batch) GROUP BY 1""")
def integrity_faults(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumns({"batch": F.concat("function_id", F.lit("/"), F.expr("CAST(ts_us DIV 3600000000 AS STRING)")),
                                              "h": F.md5(F.concat_ws(":", F.expr("CAST(CAST(cpu_utilization AS INT) AS STRING)"), F.expr("CAST(memory_spike_kb AS STRING)")))})
    return T.integrity_faults(t, "batch", "h").select("batch", "records", "duration_outlier", "duplicate_hash", "impossible_cpu", "disorder")
