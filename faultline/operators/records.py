"""Record-level projections: normalising, clamping, risk, routing, adapting, field mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline import schema as S

NAME_CAP = 256


def normalise_event(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw JSON event in column ``raw`` -> telemetry columns.

    Events spell keys in several ways; the first non-empty one counts (an empty string, 0 and
    null are all "missing"). Only the keys used are extracted.
    """
    def text(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in keys])

    def number(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{k}").try_cast("double"), F.lit(0.0)) for k in keys])

    label = F.lower(F.coalesce(text("anomaly", "anomaly_type"), F.lit("benign")))
    kind = F.when(label.isin(*S.ANOMALY_TYPES), label).otherwise("benign")
    phase = S.lookup(S.PHASE_ALIASES, F.lower(F.coalesce(text("execution_phase", "phase"), F.lit("invoke"))), "invoke")
    calls = F.get_json_object(raw, "$.network_calls")
    call_count = F.coalesce(F.when(calls.startswith("["), F.json_array_length(calls)).otherwise(calls.try_cast("int")), F.lit(0))
    flag = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}").try_cast("boolean"), F.lit(False))
    out = df.withColumns({
        "event_id": F.coalesce(text("event_id", "payload_id", "record_id"), F.lit("runtime-event")),
        "timestamp": F.coalesce(number("timestamp", "invocation_timestamp"), F.lit(0.0)),
        "function_id": F.coalesce(text("function_id", "function_profile_id", "function_name"), F.lit("runtime_function")),
        "execution_phase": phase,
        "anomaly_type": kind,
        "duration": F.coalesce(number("duration"), F.coalesce(number("telemetry_fields.duration_ms"), F.lit(0.0)) / 1000),
        "memory_spike_kb": F.coalesce(number("memory_spike_kb"), number("telemetry_fields.max_memory_used_mb") * 1024, F.lit(0.0)).cast("bigint"),
        # fixed values: assumed cpu load of an event that reports none
        "cpu_utilization": F.coalesce(number("cpu_utilization", "cpu"), F.when(kind != "benign", 88.0).otherwise(26.0)),
        "network_io_bytes": F.coalesce(number("network_io_bytes"), (call_count * 1024).cast("double")).cast("bigint"),
        "fallback_mode": flag("fallback_mode") | flag("force_starvation"),
        "concurrency_id": F.coalesce(text("concurrency_id"), F.lit("runtime-concurrency")),
        "container_id": text("container_id"),
        "region": text("region", "execution_environment.region"),
        "runtime_version": text("runtime_version", "execution_environment.runtime"),
        "trigger_type": text("trigger_type", "httpMethod"),
        "payload_size_bytes": F.coalesce(number("payload_size_bytes").cast("bigint"), F.octet_length(raw).cast("bigint")),
        **{s: F.coalesce(number(s), F.lit(0.0 if i < 3 else 1.0)) for i, s in enumerate(S.SCORES)},
        "custom_fields": F.coalesce(F.get_json_object(raw, "$.custom_fields"), F.get_json_object(raw, "$.generic_data"), F.lit("{}")),
    })
    return clamp_ranges(out)


def clamp_ranges(df: DataFrame) -> DataFrame:
    """Negative measures become 0, cpu stays in [0, 100], scores in [0, 1]; absent columns are skipped."""
    def within(c: str, lo: float, hi: float | None) -> Column:
        kind = dict(df.dtypes)[c]
        v = F.greatest(F.col(c), F.lit(lo).cast(kind))
        return F.least(v, F.lit(hi).cast(kind)) if hi is not None else v

    bounds = {"duration": (0, None), "memory_spike_kb": (0, None), "network_io_bytes": (0, None), "cpu_utilization": (0, 100)}
    bounds |= {s: (0, 1) for s in S.SCORES}
    return df.withColumns({c: within(c, lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def risk_columns(df: DataFrame) -> DataFrame:
    """Severity, category, overall risk, critical flag and emission priority."""
    df = df.withColumns({"severity": S.severity(F.col("anomaly_type")), "category": S.category(F.col("anomaly_type"))})
    df = df.withColumn("risk", F.least(F.lit(1.0), F.expr(
        "0.3D * severity / 10 + 0.25D * adversarial_score + 0.2D * economic_risk_score"
        " + 0.15D * silent_failure_probability + 0.1D * (1 - confidence_level)")))
    df = df.withColumn("critical", F.expr("severity >= 8 OR risk >= 0.8D OR category IN ('security', 'silent_failure')"))
    return df.withColumn("priority", F.expr(
        "CASE WHEN critical THEN 10 WHEN fallback_mode THEN 8 WHEN anomaly_type <> 'benign' THEN 6 ELSE 3 END"))


def write_by_priority(df: DataFrame, path: str, mode: str = "append") -> None:
    """Sink: one folder per emission priority."""
    risk_columns(df).write.mode(mode).partitionBy("priority").parquet(path)


def metric_rows(df: DataFrame, metrics: Sequence[str], ids: Sequence[str] = ("event_id",)) -> DataFrame:
    """Wide numeric columns to rows (metric, value)."""
    wide = df.select(*ids, *[F.col(m).cast("double") for m in metrics])
    return wide.unpivot(list(ids), list(metrics), "metric", "value")


def emit_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return metric_rows(df, metrics, []).groupBy("metric").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def uuid_like(value: Column) -> Column:
    """Deterministic id in UUID form, from a hash."""
    # one hash, cut by groups
    return F.regexp_replace(F.sha2(value, 256), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")


def adapt(df: DataFrame, processed_at: str | None = None) -> DataFrame:
    """Telemetry -> nested intake record.

    An event id that is no UUID is replaced by one derived from it, so reruns agree.
    """
    have = set(df.columns)
    opt = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    score = lambda s, d: F.col(s) if s in have else F.lit(d)
    eid = F.col("event_id").cast("string")
    is_uuid = eid.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
    name = F.regexp_replace(F.coalesce("function_id", F.lit("")), r"[^a-zA-Z0-9_\-.]", "_")
    phase, kind = S.intake_phase(F.col("execution_phase")), S.intake_class(F.col("anomaly_type"))
    return df.withColumns({
        "record_id": F.when(is_uuid, eid).otherwise(uuid_like(eid)),
        "function_name": F.substring(F.when(name == "", "unknown_function").otherwise(name), 1, NAME_CAP),
        "timestamp": F.col("timestamp") if "timestamp" in have else F.col("ts_us") / 1_000_000,
        "phase": phase,
        "label": kind,
        "schema_version": F.lit("v2.1"),
        "error_message": F.when(phase == "error", F.concat(F.lit("L0 execution error - anomaly: "), F.col("anomaly_type"))),
        "telemetry_data": F.struct(
            F.col("duration").alias("l0_duration_ms"), F.col("memory_spike_kb").alias("l0_memory_spike_kb"),
            F.col("cpu_utilization").alias("l0_cpu_utilization"), F.col("network_io_bytes").alias("l0_network_io_bytes"),
            opt("fallback_mode", "boolean").alias("l0_fallback_mode"), opt("payload_size_bytes", "bigint").alias("l0_payload_size_bytes"),
            opt("payload_hash").alias("l0_payload_hash"),
            F.struct(F.col("anomaly_type").alias("l0_original_anomaly_type"), F.col("execution_phase").alias("l0_original_execution_phase"),
                     F.lit(processed_at).alias("l0_processing_timestamp")).alias("layer0_metrics")),
        "provenance_chain": F.struct(
            F.lit("layer_0").alias("source_layer"), opt("parent_chain", "array<string>").alias("parent_chain"),
            F.coalesce(opt("causal_depth", "bigint"), F.lit(0)).alias("causal_depth"), opt("concurrency_id").alias("concurrency_id")),
        "context_metadata": F.struct(
            *[score(s, 0.0 if i < 3 else 1.0).alias(s) for i, s in enumerate(S.SCORES)],
            F.col("anomaly_type").alias("original_anomaly_type"), kind.alias("anomaly_normalised_to"),
            S.severity(F.col("anomaly_type")).alias("anomaly_severity"), S.category(F.col("anomaly_type")).alias("anomaly_category"),
            opt("container_id").alias("container_id"), opt("region").alias("region"), opt("runtime_version").alias("runtime_version"),
            opt("trigger_type").alias("trigger_type")),
    })


def map_fields(df: DataFrame, spec: dict[str, dict], keep_unknown: bool = True) -> DataFrame:
    """Declarative mapping: target -> {source | expr, transform, default, required}.

    ``transform`` is a SQL template with ``{}`` for the source; ``expr`` any SQL expression. A
    required field without value and default marks the row in ``mapping_errors``.
    """
    out, errors, used = [], [], set()
    for target, rule in spec.items():
        if "expr" in rule:
            value = F.expr(rule["expr"])
        else:
            used.add(rule["source"])
            value = F.expr(rule.get("transform", "{}").format(rule["source"]))
        if rule.get("default") is not None:
            value = F.coalesce(value, F.lit(rule["default"]))
        elif rule.get("required"):
            errors.append(F.when(value.isNull(), F.lit(target)))
        out.append(value.alias(target))
    rest = [F.col(c) for c in df.columns if c not in used and c not in spec] if keep_unknown else []
    failed = F.array_compact(F.array(*errors)) if errors else F.expr("CAST(array() AS array<string>)")
    return df.select(*rest, *out, failed.alias("mapping_errors"))


# SQL templates for ``map_fields``; numbers come as numbers, times as epoch seconds or ISO text
TRANSFORMS = {
    "to_string": "CAST({} AS STRING)", "to_int": "CAST(try_cast({} AS DOUBLE) AS BIGINT)", "to_float": "try_cast({} AS DOUBLE)",
    "to_bool": "coalesce(try_cast({0} AS DOUBLE) <> 0, CAST({0} AS STRING) <> '')", "to_lowercase": "lower(CAST({} AS STRING))", "to_uppercase": "upper(CAST({} AS STRING))",
    "trim": "trim(CAST({} AS STRING))", "capitalize": "concat(upper(substring({0}, 1, 1)), lower(substring({0}, 2)))", "round": "bround(CAST({} AS DOUBLE))",
    "abs": "abs(CAST({} AS DOUBLE))", "sqrt": "sqrt(CAST({} AS DOUBLE))", "to_timestamp": "CAST(unix_timestamp(CAST({} AS TIMESTAMP)) AS DOUBLE)",
    "from_timestamp": "date_format(timestamp_seconds({}), \"yyyy-MM-dd'T'HH:mm:ss+00:00\")", "format_date": "date_format(timestamp_seconds({}), 'yyyy-MM-dd')",
    "to_json": "to_json({})", "from_json": "from_json({}, 'map<string,string>')", "hash_value": "substring(md5(CAST({} AS STRING)), 1, 16)",
    "anonymize": "concat(substring({0}, 1, CASE WHEN length({0}) > 2 THEN 2 ELSE 0 END), repeat('*', length({0}) - CASE WHEN length({0}) > 2 THEN 2 ELSE 0 END))",
    "normalize": "lower(trim(CAST({} AS STRING)))",
}


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to top-level columns named by their path."""
    def walk(fields, path):
        for f in fields:
            here = [*path, f.name]
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType.fields, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))
    return df.select(*walk(df.schema.fields, []))


def correlation_id(*candidates: str) -> Column:
    """First non-empty candidate, letters, digits, dash and underscore only, at most 100 characters."""
    first = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates])
    return F.substring(F.regexp_replace(first, r"[^a-zA-Z0-9\-_]", ""), 1, 100)


def time_features(df: DataFrame) -> DataFrame:
    """The eleven columns of the classical detectors' feature row, after the id.

    Flags that the record lacks are derived: a cold start is an init phase, an error an error phase; without a
    ``source`` column no record is of the primary source.
    """
    sec = "ts_us / 1000000"
    flag = lambda name, phase: F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else (F.col("execution_phase") == phase).cast("int")
    primary = (F.upper("source") == "PRIMARY").cast("int") if "source" in df.columns else F.lit(0)
    return df.select(
        "event_id", "duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes", flag("is_cold_start", "init").alias("is_cold_start"), flag("error_occurred", "error").alias("error_occurred"),
        F.expr(f"({sec} % 86400) / 3600").alias("hour_of_day"), F.expr(f"floor({sec} / 86400) % 7").alias("day_of_week"), F.expr("memory_spike_kb / 1024").alias("memory_mb"),
        (F.upper("execution_phase") == "INVOKE").cast("int").alias("execution_phase_invoke"), primary.alias("source_primary"))


def get_path(raw: Column, path: str, default: str | None = None) -> Column:
    """Text of a nested value of a JSON object by its dotted path; ``default`` if any step is missing or the value is null."""
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))
    return F.coalesce(F.get_json_object(raw, f"${steps}"), F.lit(default))


def select_keys(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns that exist. ``a.b`` beside ``a`` keeps only the named fields of the struct ``a``."""
    out = []
    for key in (k for k in allowed if "." not in k and k in df.columns):
        inner = [k.split(".", 1)[1] for k in allowed if k.startswith(f"{key}.")]
        kind = df.schema[key].dataType
        if inner and hasattr(kind, "fieldNames"):
            out.append(F.struct(*[F.col(f"`{key}`.`{i}`").alias(i) for i in inner if i in kind.fieldNames()]).alias(key))
        else:
            out.append(F.col(f"`{key}`"))
    return df.select(*out)


def deep_merge(a: Column, b: Column, left, right) -> Column:
    """One struct of both (types ``left`` and ``right``): fields of ``b`` win, structs on both sides are merged."""
    fields = []
    for name in [*left.fieldNames(), *(n for n in right.fieldNames() if n not in left.fieldNames())]:
        if name not in right.fieldNames():
            value = a.getField(name)
        elif name in left.fieldNames() and hasattr(left[name].dataType, "fieldNames") and hasattr(right[name].dataType, "fieldNames"):
            value = deep_merge(a.getField(name), b.getField(name), left[name].dataType, right[name].dataType)
        else:
            value = b.getField(name)
        fields.append(value.alias(name))
    return F.struct(*fields)


# --- fixed values: the formats of a time ---
TIME_FORMATS = {"iso": "yyyy-MM-dd'T'HH:mm:ssXXX", "human": "yyyy-MM-dd HH:mm:ss 'UTC'", "compact": "yyyyMMdd_HHmmss"}


def format_timestamp(seconds: Column, kind: str = "iso") -> Column:
    """Epoch seconds as text (session zone UTC): iso, human, compact, milliseconds, else six decimals."""
    if kind == "milliseconds":
        return F.floor(seconds * 1000).cast("string")
    if kind not in TIME_FORMATS:
        return F.format_string("%.6f", seconds)
    text = F.date_format(F.timestamp_seconds(seconds), TIME_FORMATS[kind])
    return F.regexp_replace(text, "Z$", "+00:00") if kind == "iso" else text


def duration_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, never below zero."""
    return F.greatest(F.lit(0.0), (end - start).cast("double"))
