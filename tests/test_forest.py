import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators.detectors.forest import Forest, history_forest, path_norm


def records(spark, n, keys=1, odd=()):
    """Gaussian-like metrics by id hash; the ids in ``odd`` lie far outside."""
    u = lambda i: (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) + F.pmod(F.xxhash64("id", F.lit(i + 50)), F.lit(1000))) / 100
    away = F.when(F.col("id").isin(list(odd)), 100.0).otherwise(0.0)
    return spark.range(n).select(F.col("id").alias("event_id"), F.concat(F.lit("f"), (F.col("id") % keys).cast("string")).alias("function_id"), (F.col("id") * 1_000_000).alias("ts_us"),
                                 F.lit("invoke").alias("execution_phase"), F.lit("benign").alias("anomaly_type"), (u(1) + away).alias("duration"), (u(2) * 100 + away * 100).cast("long").alias("memory_spike_kb"),
                                 (u(3) + away).alias("cpu_utilization"), (u(4) * 1000).cast("long").alias("network_io_bytes"))


def test_forest_against_single_walks():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 3)), np.repeat([[2.0, 2.0, 2.0]], 40, axis=0)])
    f = Forest(x, 20, 64, np.random.default_rng(2))

    def walk(t, row):
        node = 0
        while f.feature[t, node] >= 0:
            node = 2 * node + 1 + int(row[f.feature[t, node]] >= f.cut[t, node])
        return f.depth[t, node]

    probe = np.vstack([x[:30], [[9.0, 9.0, 9.0]]])
    want = [-(2.0 ** (-np.mean([walk(t, r) for t in range(20)]) / f.norm)) for r in probe]
    assert f.score(probe) == pytest.approx(want)
    assert f.score(probe)[-1] < np.quantile(f.score(x), 0.1)
    for t in range(20):
        assert 0 < f.depth[t][f.depth[t] > 0].min() and f.depth[t].max() <= f.levels + path_norm(64)


def test_constant_and_repeated_rows():
    f = Forest(np.ones((60, 4)), 10, 256, np.random.default_rng(0))
    assert len(set(f.score(np.array([[1.0] * 4, [5.0] * 4])))) == 1  # nothing to split on: all alike


def test_models_are_the_last_before_each_record(spark):
    got = {r["event_id"]: r for r in history_forest(records(spark, 900), trees=10, limit=300, step=200).collect()}
    assert len(got) == 900
    for i, r in got.items():
        before = i  # rows before this one
        cut = 0 if before < 49 else max([c for c in (49, 98, 196) if c <= before] + ([before - before % 200] if before >= 200 else []))
        assert r["model_rows"] == min(cut, 300), i
        assert (r["decision"] is None) == (before < 49)


def test_planted_outliers_and_gate(spark):
    odd = {120, 430, 777}
    rows = records(spark, 800, odd=odd)
    got = {r["event_id"]: r for r in history_forest(rows, gate=0.1).collect()}
    assert all(got[i]["outlier"] and got[i]["detected"] and got[i]["anomaly_type"] == "execution_failure" for i in odd)
    rest = [r for i, r in got.items() if i not in odd and r["decision"] is not None]
    assert min(got[i]["confidence"] for i in odd) > max(-r["decision"] for r in rest)
    assert sum(r["outlier"] for r in rest) / len(rest) < 0.25
    assert all(r["confidence"] == abs(r["decision"]) for r in rest)
    assert not any(r["detected"] for r in history_forest(rows).collect() if r["decision"] is not None)  # the gate of 0.6 is out of reach


def test_same_answer_for_any_partitioning_and_hot_keys_are_cut(spark):
    rows = records(spark, 1500, keys=2).withColumn("function_id", F.when(F.col("event_id") % 10 > 0, "hot").otherwise(F.col("function_id")))
    one = history_forest(rows.coalesce(1), trees=10, limit=400, step=200)
    many = history_forest(rows.repartition(7), trees=10, limit=400, step=200)
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.where("decision IS NOT NULL").agg(F.max("model_rows")).first()[0] == 400


def test_empty_null_and_clashing_columns(spark):
    rows = records(spark, 120)
    assert history_forest(rows.where("false")).count() == 0
    nulls = rows.withColumn("duration", F.when(F.col("event_id") % 2 == 0, F.col("duration"))).withColumns({"past": F.lit(1), "_id": F.lit(2), "at": F.lit(3)})
    assert history_forest(nulls).count() == 120
