"""Record schema and closed vocabularies.

The vocabularies are small literal maps, so they become ``create_map`` literals in the plan:
no dimension join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values: anomaly vocabulary, name -> (severity 0-10, category, class at intake) ---
ANOMALY_TYPES = {
    "benign": (0, "normal", "benign"),
    "cold_start": (2, "performance", "suspicious"),
    "cpu_burst": (3, "performance", "suspicious"),
    "memory_spike": (3, "performance", "suspicious"),
    "io_intensive": (2, "performance", "suspicious"),
    "network_anomaly": (4, "execution", "suspicious"),
    "timeout_anomaly": (4, "execution", "suspicious"),
    "execution_failure": (6, "execution", "suspicious"),
    "starvation_fallback": (5, "system", "suspicious"),
    "timeout_fallback": (5, "system", "suspicious"),
    "schema_violation": (4, "system", "suspicious"),
    "adversarial_injection": (9, "security", "malicious"),
    "billing_abuse": (8, "security", "malicious"),
    "dos_amplification": (9, "security", "malicious"),
    "cryptomining": (7, "security", "malicious"),
    "data_exfiltration": (10, "security", "malicious"),
    "privilege_escalation": (10, "security", "malicious"),
    "silent_corruption": (8, "silent_failure", "suspicious"),
    "semantic_failure": (7, "silent_failure", "suspicious"),
    "output_corruption": (6, "silent_failure", "suspicious"),
    "invariant_violation": (5, "silent_failure", "suspicious"),
}

# --- fixed values: execution phases, name -> (label, expected seconds lo, hi, name at intake) ---
PHASES = {
    "init": ("Initialization", 0.05, 2.0, "initialization"),
    "invoke": ("Invocation", 0.01, 15.0, "execution"),
    "shutdown": ("Shutdown", 0.001, 0.1, "completion"),
    "error": ("Error Handling", 0.001, 1.0, "error"),
    "timeout": ("Timeout Recovery", 0.001, 0.5, "timeout"),
}

# --- fixed values: spellings of a phase accepted in raw events ---
PHASE_ALIASES = {
    "init": "init",
    "initialization": "init",
    "invoke": "invoke",
    "execution": "invoke",
    "shutdown": "shutdown",
    "completion": "shutdown",
    "error": "error",
    "timeout": "timeout",
}

# --- fixed values: trust of a telemetry source ---
SOURCE_TRUST = {
    "primary": 1.0,
    "adversarial-simulator": 0.7,
    "fallback-generator": 0.5,
    "economic-detector": 0.9,
    "graph-builder": 0.9,
    "provenance-tracker": 0.95,
    "silent-failure-detector": 0.8,
    "formal-verifier": 0.95,
    "external-injector": 0.3,
}

FAILURE_TYPES = ("execution_failure", "timeout_fallback")
SCORES = (
    "adversarial_score",
    "economic_risk_score",
    "silent_failure_probability",
    "completeness_score",
    "confidence_level",
    "data_quality_score",
)

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("function_id", T.StringType()),
        T.StructField("execution_phase", T.StringType()),
        T.StructField("anomaly_type", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("memory_spike_kb", T.LongType()),
        T.StructField("cpu_utilization", T.DoubleType()),
        T.StructField("network_io_bytes", T.LongType()),
        T.StructField("fallback_mode", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("concurrency_id", T.StringType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("runtime_version", T.StringType()),
        T.StructField("trigger_type", T.StringType()),
        T.StructField("payload_size_bytes", T.LongType()),
        T.StructField("payload_hash", T.StringType()),
        T.StructField("parent_chain", T.ArrayType(T.StringType())),
        T.StructField("causal_depth", T.LongType()),
        *[T.StructField(s, T.DoubleType()) for s in SCORES],
        T.StructField("custom_fields", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)


def lookup(values: dict, key: Column, default) -> Column:
    """Value of a literal map, or ``default`` for an unknown key."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def severity(anomaly_type: Column) -> Column:
    return lookup({k: v[0] for k, v in ANOMALY_TYPES.items()}, anomaly_type, 5)


def category(anomaly_type: Column) -> Column:
    return lookup({k: v[1] for k, v in ANOMALY_TYPES.items()}, anomaly_type, "unknown")


def intake_class(anomaly_type: Column) -> Column:
    return lookup({k: v[2] for k, v in ANOMALY_TYPES.items()}, anomaly_type, "unknown")


def intake_phase(phase: Column) -> Column:
    return lookup({k: v[3] for k, v in PHASES.items()}, phase, "execution")


def source_trust(source: Column) -> Column:
    return lookup(SOURCE_TRUST, source, 0.5)
