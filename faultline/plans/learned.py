"""Queries of the learned detectors and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import detectors as D, evaluation as V, fusion, models as M, neighbours as N, one_class as O
from faultline.operators.detectors import forest
from faultline.plans.common import TEL, Query, dbscan_sql, gap, r
from faultline.plans.detectors import _FUSED
from faultline.sources.tables import telemetry

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COLS = ["duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes"]


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _parts(spark, sf_dir):
    """All benign rows train, everything is scored."""
    t = telemetry(spark, sf_dir).withColumn("label", F.col("anomaly_type") != "benign")
    return t.where("anomaly_type = 'benign'"), t


_TRAIN = "tr AS (SELECT * FROM tel WHERE anomaly_type = 'benign')"


@query(f"""WITH {TEL}, {_TRAIN}, f AS (SELECT avg(duration) AS m1, stddev_pop(duration) AS s1, avg(memory_spike_kb) AS m2, stddev_pop(memory_spike_kb) AS s2, avg(cpu_utilization) AS m3, stddev_pop(cpu_utilization) AS s3, avg(network_io_bytes) AS m4, stddev_pop(network_io_bytes) AS s4 FROM tr)
SELECT event_id, round(greatest(abs(duration - m1) / s1, abs(memory_spike_kb - m2) / s2, abs(cpu_utilization - m3) / s3, abs(network_io_bytes - m4) / s4), 6) AS score FROM tel, f""")
def zscore_detector(spark, sf_dir):
    return M.zscore(*_parts(spark, sf_dir), COLS).select("event_id", r("score").alias("score"))


@query(f"""WITH {TEL}, {_TRAIN}, f AS (SELECT quantile_cont(duration, [0.25, 0.75]) AS a, quantile_cont(memory_spike_kb::DOUBLE, [0.25, 0.75]) AS b, quantile_cont(cpu_utilization, [0.25, 0.75]) AS c, quantile_cont(network_io_bytes::DOUBLE, [0.25, 0.75]) AS d FROM tr)
SELECT event_id, round(greatest(0, (a[1] - duration) / (a[2] - a[1]) - 1.5, (duration - a[2]) / (a[2] - a[1]) - 1.5, (b[1] - memory_spike_kb) / (b[2] - b[1]) - 1.5, (memory_spike_kb - b[2]) / (b[2] - b[1]) - 1.5,
  (c[1] - cpu_utilization) / (c[2] - c[1]) - 1.5, (cpu_utilization - c[2]) / (c[2] - c[1]) - 1.5, (d[1] - network_io_bytes) / (d[2] - d[1]) - 1.5, (network_io_bytes - d[2]) / (d[2] - d[1]) - 1.5), 6) AS score FROM tel, f""")
def iqr_detector(spark, sf_dir):
    return M.iqr(*_parts(spark, sf_dir), COLS).select("event_id", r("score").alias("score"))


@query(f"""WITH {TEL} SELECT event_id, round(CASE WHEN count(*) OVER w >= 3 THEN greatest(abs(duration - avg(duration) OVER w) / coalesce(nullif(stddev_pop(duration) OVER w, 0), 1e-8), abs(cpu_utilization - avg(cpu_utilization) OVER w) / coalesce(nullif(stddev_pop(cpu_utilization) OVER w, 0), 1e-8)) ELSE 0 END, 4) AS score
FROM tel WINDOW w AS (PARTITION BY function_id ORDER BY ts_us, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def moving_average_detector(spark, sf_dir):
    return M.moving_average(telemetry(spark, sf_dir), ["duration", "cpu_utilization"]).select("event_id", r("score", 4).alias("score"))


@query(None)
def kmeans_detector(spark, sf_dir):
    return M.kmeans_distance(*_parts(spark, sf_dir), COLS).select("event_id", r("score").alias("score"), (F.col("score") > F.col("threshold")).alias("anomalous"))


@query(None)
def elliptic_envelope_detector(spark, sf_dir):
    return M.elliptic_envelope(*_parts(spark, sf_dir), COLS).select("event_id", r("score").alias("score"), (F.col("score") > F.col("threshold")).alias("anomalous"))


@query(None)
def isolation_forest_detector(spark, sf_dir):
    return M.isolation_forest(*_parts(spark, sf_dir), COLS).select("event_id", r("score").alias("score"), (F.col("score") > F.col("threshold")).alias("anomalous"))


@query(None)
def history_forest(spark, sf_dir):
    out = forest.history_forest(telemetry(spark, sf_dir))
    return out.select("event_id", "outlier", "detected", "anomaly_type", r("confidence").alias("confidence"), r("decision").alias("decision"), "model_rows")


def _held_out(spark, sf_dir):
    """Four fifths of the benign rows train, everything else is scored."""
    t = telemetry(spark, sf_dir).withColumn("label", F.col("anomaly_type") != "benign")
    fit = F.expr("anomaly_type = 'benign' AND event_id % 5 <> 4")
    return t.where(fit), t.where(~fit)


_SPLIT = f"""WITH RECURSIVE {TEL}, tr AS (SELECT * FROM tel WHERE anomaly_type = 'benign' AND event_id % 5 <> 4), te AS (SELECT * FROM tel WHERE NOT (anomaly_type = 'benign' AND event_id % 5 <> 4)),
f AS (SELECT avg(duration) AS m1, stddev_pop(duration) AS s1, avg(memory_spike_kb) AS m2, stddev_pop(memory_spike_kb) AS s2, avg(cpu_utilization) AS m3, stddev_pop(cpu_utilization) AS s3, avg(network_io_bytes) AS m4, stddev_pop(network_io_bytes) AS s4 FROM tr),
u AS MATERIALIZED (SELECT event_id AS id, (duration - m1) / s1 AS a, (memory_spike_kb - m2) / s2 AS b, (cpu_utilization - m3) / s3 AS c, (network_io_bytes - m4) / s4 AS d FROM tr, f),
v AS MATERIALIZED (SELECT event_id AS id, (duration - m1) / s1 AS a, (memory_spike_kb - m2) / s2 AS b, (cpu_utilization - m3) / s3 AS c, (network_io_bytes - m4) / s4 AS d FROM te, f)"""


def _lof_sql(k: int) -> str:
    near = "unnest(min({{'d': {}, 'r': y.rep, 'o': y.id}}, {})) AS n"
    return f"""{_SPLIT}, w AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY a, b, c, d) AS rep FROM u),
n AS MATERIALIZED (SELECT id, n.d AS dist, n.o AS o FROM (SELECT x.id, {near.format(gap("x", "y"), k)} FROM w x JOIN w y ON x.id <> y.id GROUP BY x.id)),
k AS (SELECT id, max(dist) AS reach FROM n GROUP BY id),
l AS (SELECT n.id, 1 / (avg(greatest(dist, reach)) + 1e-10) AS lrd FROM n JOIN k ON k.id = n.o GROUP BY n.id),
g AS (SELECT n.id, avg(o.lrd) / any_value(l.lrd) AS lof FROM n JOIN l o ON o.id = n.o JOIN l ON l.id = n.id GROUP BY n.id),
q AS MATERIALIZED (SELECT id, n.d AS dist, n.o AS o FROM (SELECT x.id, {near.format(gap("x", "y"), k)} FROM v x, w y GROUP BY x.id)),
h AS (SELECT q.id, avg(lrd) * (avg(greatest(dist, reach)) + 1e-10) AS lof FROM q JOIN k ON k.id = q.o JOIN l ON l.id = q.o GROUP BY q.id)
SELECT id AS event_id, round(lof, 5) AS lof, round((lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER ()), 5) AS score, lof > (SELECT quantile_cont(lof, 0.9) FROM g) AS anomalous FROM h"""


def _lof(spark, sf_dir, k):
    out = N.local_outlier_factor(*_held_out(spark, sf_dir), COLS, k)
    return out.select("event_id", r("lof", 5).alias("lof"), r("score", 5).alias("score"), (F.col("score") > F.col("threshold")).alias("anomalous"))


@query(_lof_sql(10))
def lof_detector_10(spark, sf_dir):
    return _lof(spark, sf_dir, 10)


@query(_lof_sql(20))
def lof_detector_20(spark, sf_dir):
    return _lof(spark, sf_dir, 20)


@query(f"""{_SPLIT}, {dbscan_sql("u", "abcd", 0.5, 5)},
ctr AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d FROM z JOIN u USING (id) WHERE cluster IS NOT NULL GROUP BY cluster),
m AS (SELECT v.id, min({gap("v", "ctr")}) AS dist FROM v, ctr GROUP BY v.id)
SELECT id AS event_id, round(dist / max(dist) OVER (), 5) AS score, dist > avg(dist) OVER () + 2 * stddev_pop(dist) OVER () AS anomalous FROM m""")
def dbscan_detector(spark, sf_dir):
    out = N.dbscan_distance(*_held_out(spark, sf_dir), COLS)
    return out.select("event_id", r("score", 5).alias("score"), (F.col("score") > F.col("threshold")).alias("anomalous"))


def _svm(spark, sf_dir, nu):
    out = O.one_class_svm(*_held_out(spark, sf_dir), COLS, nu)
    return out.select("event_id", r("decision").alias("decision"), r("score").alias("score"), (F.col("decision") < 0).alias("anomalous"))


@query(None)
def one_class_svm_detector_10(spark, sf_dir):
    return _svm(spark, sf_dir, 0.10)


@query(None)
def one_class_svm_detector_05(spark, sf_dir):
    return _svm(spark, sf_dir, 0.05)


@query(None)
def detector_comparison(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    runs = {"zscore_2.5": M.zscore(train, test, COLS, 2.5), "zscore_3.0": M.zscore(train, test, COLS, 3.0), "iqr_1.5": M.iqr(train, test, COLS, 1.5),
            "moving_average": M.moving_average(test, COLS), "kmeans": M.kmeans_distance(train, test, COLS), "elliptic_envelope": M.elliptic_envelope(train, test, COLS),
            "isolation_forest": M.isolation_forest(train, test, COLS)}
    long = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("detector"), "label", "score", "threshold")
        long = part if long is None else long.unionAll(part)
    return V.compare_detectors(long).select("detector", "rank", *[r(c).alias(c) for c in ("precision", "recall", "f1", "auc")])


@query(_FUSED + """SELECT event_id, round(sum(y) + 1e-7, 4) AS mean, round(26 * var_pop(y) + 1e-7, 5) AS variance, round(greatest(0, sum(y) - 1.96 * sqrt(26 * var_pop(y))) + 1e-7, 4) AS ci95_low FROM (SELECT event_id, CASE WHEN detected THEN confidence ELSE 0 END * w / sum(w) OVER (PARTITION BY event_id) AS y FROM t) GROUP BY event_id""")
def fusion_confidence(spark, sf_dir):
    out = fusion.confidence_interval(fusion.fuse(D.detect(telemetry(spark, sf_dir))))
    return out.select("event_id", r(F.col("bootstrap_mean") + 1e-7, 4).alias("mean"), r(F.col("bootstrap_variance") + 1e-7, 5).alias("variance"), r(F.col("ci95_low") + 1e-7, 4).alias("ci95_low"))
