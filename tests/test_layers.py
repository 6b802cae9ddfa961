"""Golden values of the canonical layers and of evaluation."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import evaluation as V, layers, records, validation
from faultline.functions import text as TX


def record(spark, **over):
    base = dict(event_id="e1", function_id="fn/1 x", ts_us=1_000_000, execution_phase="invoke", anomaly_type="benign", duration=0.5, memory_spike_kb=1024, cpu_utilization=20.0,
                network_io_bytes=100, adversarial_score=0.0, economic_risk_score=0.0, silent_failure_probability=0.0, completeness_score=1.0, confidence_level=1.0, data_quality_score=1.0)
    base |= over
    return spark.createDataFrame([tuple(base.values())], list(base))


def run(spark, **over):
    return layers.run_pipeline(record(spark, **over)).first()


def test_benign_record(spark):
    r = run(spark)
    assert r.function_name == "fn_1_x" and r.decision == "observe" and r.risk_band == "low"
    assert r.preservation == 1.0 and r.trust_score == 1.0 and r.completeness == 1.0
    assert abs(r.aggregate_score - round(0.1 * 0.75 / 2.7, 4)) < 1e-9
    assert list(r.tactics) == ["collection"] and r.alignment_confidence == 0.6


def test_loud_record(spark):
    r = run(spark, anomaly_type="data_exfiltration", duration=1.0, memory_spike_kb=131072, cpu_utilization=80.0, network_io_bytes=4096)
    assert r.rule_chain == pytest.approx(0.9) and r.semantic_deviation == pytest.approx(0.75)  # thresholds are inclusive
    assert r.decision == "review" and r.label == "malicious"


def test_processing_time_is_taken_for_a_phone_number(spark):
    good = layers.intake(records.adapt(record(spark), "2024-01-02T00:00:00")).first()
    assert good.preservation == 0.85 and good.redacted_fields == ["telemetry_data.layer0_metrics.l0_processing_timestamp"]


def test_invalid_records_go_to_quarantine(spark):
    good, bad = layers.split_valid(layers.intake(records.adapt(record(spark, cpu_utilization=150.0, duration=-1.0))))
    assert good.count() == 0
    assert {e.field for e in bad.first().errors} == {"telemetry_data.l0_cpu_utilization", "telemetry_data.l0_duration_ms"}


def test_verbosity(spark):
    df = layers.detection_matrix(layers.intake(records.adapt(record(spark)))).transform(layers.trust_fusion)
    assert layers.decision_trace(df, "terse").first().explanation_points == []
    assert len(layers.decision_trace(df, "verbose", 3).first().trace_redacted) == 3
    with pytest.raises(ValueError):
        layers.decision_trace(df, "loud")


def test_normalise_event(spark):
    raw = '{"payload_id":"p1","event_id":"","anomaly":"COLD_START","execution_phase":"completion","telemetry_fields":{"duration_ms":1500,"max_memory_used_mb":2},"network_calls":[1,2,3],"force_starvation":true}'
    r = records.normalise_event(spark.createDataFrame([(raw,)], ["raw"])).first()
    assert (r.event_id, r.anomaly_type, r.execution_phase, r.duration, r.memory_spike_kb, r.network_io_bytes, r.cpu_utilization, r.fallback_mode) == (
        "p1", "cold_start", "shutdown", 1.5, 2048, 3072, 88.0, True)


def test_auc_and_threshold_rules(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9)], "y int, s double")
    assert V.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    sweep = V.threshold_sweep(df, "y", "s", V.sweep_thresholds())
    best = V.pick_threshold(sweep).first()
    assert best.threshold == pytest.approx(0.40) and best.recall == 1.0


def test_rules(spark):
    df = spark.createDataFrame([("x", "not-mail")], "a string, b string")
    out = validation.validate_rules(df, [{"field": "a", "kind": "type", "type": "int"}, {"field": "b", "kind": "email"}]).first()
    assert out.failed_rules == ["a:type", "b:email"]


def test_signals_are_ranked_without_a_lambda(spark):
    """A sort by a lambda is interpreted for each record; e-mail addresses are only searched in texts with an at sign."""
    assert "array_sort(" not in str(layers._ranked())
    assert "contains(" in str(TX.redact_intake(F.col("t")))
    texts = spark.createDataFrame([("a.b@c.de call 123 456 789",), ("plain 7",), ("x@y",), (None,)], "t string")
    assert [r[0] for r in texts.select(TX.redact_intake(F.col("t"))).collect()] == ["[REDACTED_EMAIL] call [REDACTED_PHONE]", "plain 7", "x@y", None]
