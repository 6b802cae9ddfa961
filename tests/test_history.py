"""Blocks and halos must not change results; small blocks are compared with plain Python."""

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import detectors as D, economic, history as H, trust
from faultline.operators.quantiles import exact_quantiles
from faultline.sources.tables import telemetry


def _hot(spark, sf_dir):
    """A third and more of all rows under one key."""
    t = telemetry(spark, sf_dir)
    return t.withColumn("function_id", F.when(F.col("event_id") % 5 < 3, "hot").otherwise(F.col("function_id")))


def test_index_is_dense(spark, sf_dir):
    rows = H.index_rows(_hot(spark, sf_dir), ["function_id"]).select("function_id", "ts_us", "event_id", "rn", "key_rows").collect()
    by = {}
    for r in rows:
        by.setdefault(r.function_id, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (r.ts_us, r.event_id))
        assert [r.rn for r in rs] == list(range(1, len(rs) + 1))
        assert {r.key_rows for r in rs} == {len(rs)}


def test_detectors_do_not_depend_on_blocks(spark, sf_dir):
    t = _hot(spark, sf_dir)
    a = D.detect(t, limit=90, block=180)
    b = D.detect(t, limit=90, block=100_000)
    names = sorted(D.DETECTORS)
    pick = lambda df: {r.event_id: r for r in df.select("event_id", *[F.struct(F.col(f"{n}.detected"), F.round(f"{n}.confidence", 6), F.col(f"{n}.anomaly_type")).alias(n) for n in names]).collect()}
    x, y = pick(a), pick(b)
    assert x.keys() == y.keys() and len(x) == t.count()
    for k in x:
        for n in names:
            assert x[k][n] == y[k][n], (k, n, x[k][n], y[k][n])


def test_history_limit_against_python(spark, sf_dir):
    """z-score, percentiles and maximum over the last ``limit`` rows only."""
    limit, t = 40, _hot(spark, sf_dir)
    got = {r.event_id: r for r in D.detect(t, ["statistical_outlier", "duration_outlier", "performance_regression"], limit=limit, block=100)
           .select("event_id", F.col("statistical_outlier.confidence").alias("z"), F.col("duration_outlier.features").alias("q"), F.col("performance_regression.features").alias("h")).collect()}
    rows = sorted((r for r in t.where("function_id = 'hot'").collect()), key=lambda r: (r.ts_us, r.event_id))
    for i in (5, 45, 123, 300, len(rows) - 1):
        hist = rows[max(0, i - limit + 1): i + 1]
        q = got[rows[i].event_id].q
        d = [r.duration for r in hist]
        if len(hist) >= 20:
            for p, name in ((1, "q.p1"), (50, "q.p50"), (99, "q.p99")):
                assert abs(q[name] - np.percentile(d, p)) < 1e-9
        if len(hist) >= 10:
            prev = hist[:-1]
            z = 0.0
            for f in ("duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes"):
                v = np.array([getattr(r, f) for r in prev], float)
                if v.std() > 0:
                    z = max(z, abs(getattr(rows[i], f) - v.mean()) / v.std())
            assert abs(got[rows[i].event_id].z - min(z / 5, 1)) < 1e-6
        if len(hist) >= 20:
            half = len(hist) // 2
            rise = (np.mean(d[half:]) - np.mean(d[:half])) / (np.mean(d[:half]) + 0.001)
            assert abs(got[rows[i].event_id].h["pr_d"] - (rise if rise > 0.1 else 0)) < 1e-6


def test_clipped_running_sum(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, i, float(rng.choice([-0.05, 0.05, 0.07]))) for k in ("a", "b") for i in range(1 if k == "b" else 100)]
    df = spark.createDataFrame(rows, "k string, t long, id long, d double")
    out = {(r.k, r.id): r for r in trust.clipped_running_sum(df, ["k"], "t", "id", "d", 0.8, 0.1, 1.0, block=3).collect()}
    for k in ("a", "b"):
        x = 0.8
        for n, (_, _, i, d) in enumerate([r for r in rows if r[0] == k], 1):
            x = min(1.0, max(0.1, x + d))
            assert abs(out[(k, i)].running - x) < 1e-9 and out[(k, i)].position == n


def test_exact_quantiles_beyond_the_sketch(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.lognormal(size=3000), np.zeros(1500)]).round(3)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0)], "k string, v double")
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    for acc in (100, 10_000):
        got = {(r.k, r.p): r.q for r in exact_quantiles(df, ["k"], "v", probs, accuracy=acc).collect()}
        for p in probs:
            assert abs(got[("a", p)] - np.percentile(v, p * 100)) < 1e-9
            assert got[("b", p)] == 1.0


def test_one_exchange_for_the_engine(spark, sf_dir):
    """All window work happens in the (key, block) partitioning: one exchange after the row index."""
    df = D.detect(telemetry(spark, sf_dir))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    full = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert full.count("Exchange hashpartitioning(function_id") <= 6


def test_invocation_limit_holds_inside_a_block(spark):
    """The count never exceeds the limit, wherever a block ends."""
    rows = spark.range(900).selectExpr("id AS event_id", "'f' AS function_id", "id * 100000 AS ts_us", "1.0D AS duration", "100L AS memory_spike_kb", "10.0D AS cpu_utilization", "10L AS network_io_bytes")
    got = {r.event_id: r.recent_count for r in economic.invocation_pattern(rows, limit=50).select("event_id", "recent_count").collect()}
    assert got == {i: min(i + 1, 50) for i in range(900)}
    wide = {r.event_id: r.recent_count for r in economic.invocation_pattern(rows, limit=5000).select("event_id", "recent_count").collect()}
    assert wide == {i: min(i + 1, 601) for i in range(900)}
