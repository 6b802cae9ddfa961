"""Validation: every rule is a ``when`` in an error array, so one pass reports all faults of a row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from faultline import schema as S


def _errors(found: Iterable[Column]) -> Column:
    return F.array_compact(F.array(*found))


def _fault(test: Column, field: str, message: str) -> Column:
    return F.when(test, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


# --- fixed values: bounds and length caps at intake ---
INTAKE_BOUNDS = {
    **{f"context_metadata.{s}": (0.0, 1.0) for s in S.SCORES},
    "context_metadata.anomaly_severity": (0.0, 10.0),
    "telemetry_data.l0_duration_ms": (0.0, None),
    "telemetry_data.l0_memory_spike_kb": (0.0, None),
    "telemetry_data.l0_cpu_utilization": (0.0, 100.0),
    "telemetry_data.l0_network_io_bytes": (0.0, None),
    "telemetry_data.l0_payload_size_bytes": (0.0, None),
}
LENGTH_CAPS = {"function_name": 256, "schema_version": 32, "record_id": 128}
PHASES = ("initialization", "execution", "completion", "error", "timeout")
CLASSES = ("benign", "suspicious", "malicious", "unknown")


def validate_intake(df: DataFrame) -> DataFrame:
    """``errors`` of adapted records: required fields, vocabularies, lengths, bounds, conditions."""
    found = []
    for f in ("record_id", "timestamp", "function_name", "phase", "label", "telemetry_data", "schema_version"):
        found.append(_fault(F.col(f).isNull(), f, "required field is missing or null"))
        if dict(df.dtypes)[f] == "string":
            found.append(_fault(F.trim(f) == "", f, "required string field must not be empty"))
    found.append(_fault(~F.col("phase").isin(*PHASES) & (F.col("phase") != ""), "phase", "not an execution phase"))
    found.append(_fault(~F.col("label").isin(*CLASSES) & (F.col("label") != ""), "label", "not an anomaly class"))
    found += [_fault(F.length(f) > cap, f, f"exceeds max length {cap}") for f, cap in LENGTH_CAPS.items()]
    for f, (lo, hi) in INTAKE_BOUNDS.items():
        found.append(_fault(F.col(f) < lo, f, f"must be >= {lo:g}"))
        if hi is not None:
            found.append(_fault(F.col(f) > hi, f, f"must be <= {hi:g}"))
    found.append(_fault((F.col("phase") == "error") & (F.coalesce(F.trim("error_message"), F.lit("")) == ""),
                        "error_message", "required when phase is error"))
    return df.withColumn("errors", _errors(found))


# --- fixed values: telemetry rules ---
REQUIRED = ("event_id", "timestamp", "function_id", "execution_phase", "anomaly_type", "duration", "memory_spike_kb",
            "cpu_utilization", "network_io_bytes", "fallback_mode", "source")
RANGES = {
    "duration": (0, 900), "memory_spike_kb": (0, 3008 * 1024), "cpu_utilization": (0, 100), "network_io_bytes": (0, 1024**3),
    "adversarial_score": (0, 1), "economic_risk_score": (0, 1), "silent_failure_probability": (0, 1),
    "completeness_score": (0, 1), "confidence_level": (0, 1),
}
ID_PATTERNS = {"event_id": r"^[a-zA-Z0-9\-_]{8,64}", "function_id": r"^[a-zA-Z0-9\-_.:]{1,128}"}


def validate_telemetry(df: DataFrame, as_of: float) -> DataFrame:
    """``errors``, ``warnings``, ``valid`` and a quality score; ``as_of`` (epoch s) stands for now."""
    have = set(df.columns)
    # --- fixed values: the message texts ---
    errors = [F.lit(f"Missing required field: {f}") for f in REQUIRED if f not in have]
    errors += [F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f"Empty required field: {f}")) for f in REQUIRED if f in have]
    warn = [F.when((F.col(f) < lo) | (F.col(f) > hi), F.lit(f"{f} outside expected range")) for f, (lo, hi) in RANGES.items() if f in have]
    warn += [F.when((F.col(f).cast("string") != "") & ~F.col(f).cast("string").rlike(p), F.lit(f"{f} doesn't match expected pattern"))
             for f, p in ID_PATTERNS.items() if f in have]
    warn.append(F.when((F.col("execution_phase") == "init") & (F.col("duration") > 60), "Init phase duration seems unusually long"))
    warn.append(F.when(F.col("memory_spike_kb") > 1024 * 1024, "Memory usage seems unusually high"))
    if "timestamp" in have:
        warn.append(F.when(F.col("timestamp") > as_of, "Timestamp is in the future")
                    .when(F.lit(as_of) - F.col("timestamp") > 86400, "Timestamp is unusually old"))
    df = df.withColumns({"errors": _errors(errors), "warnings": _errors(warn)})
    return df.withColumns({
        "valid": F.size("errors") == 0,
        "quality_score": F.greatest(F.lit(0.0), 1.0 - 0.3 * F.size("errors") - 0.05 * F.size("warnings")),
    })


def validate_contract(df: DataFrame, contract: dict, name: str = "violations") -> DataFrame:
    """Violations of a contract ``{fields: {name: {type, required, min, max, enum}}, additional: bool}``."""
    found, types = [], dict(df.dtypes)
    say = lambda test, f, what: F.when(test, F.struct(F.lit(f).alias("field"), F.lit(what).alias("violation")))
    for f, rule in contract["fields"].items():
        if f not in types:
            if rule.get("required"):
                found.append(say(F.lit(True), f, "missing_required_field"))
            continue
        c = F.col(f)
        if rule.get("required"):
            found.append(say(c.isNull(), f, "missing_required_field"))
        if rule.get("type") and types[f] == "string" and rule["type"] != "string":
            c = c.try_cast(rule["type"])
            found.append(say(F.col(f).isNotNull() & c.isNull(), f, "type_mismatch"))
        if "min" in rule:
            found.append(say(c < rule["min"], f, "below_minimum"))
        if "max" in rule:
            found.append(say(c > rule["max"], f, "above_maximum"))
        if "enum" in rule:
            found.append(say(~c.isin(*rule["enum"]), f, "not_in_enum"))
    if contract.get("additional") is False:
        found += [say(F.col(f).isNotNull(), f, "additional_property") for f in types if f not in contract["fields"]]
    return df.withColumn(name, _errors(found))


def violation_counts(df: DataFrame, name: str = "violations") -> DataFrame:
    return df.select(F.inline(name)).groupBy("field", "violation").agg(F.count(F.lit(1)).alias("n"))


# assumed values: formats
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}


def validate_rules(df: DataFrame, rules: list[dict], name: str = "failed_rules") -> DataFrame:
    """Rules ``{field, kind, ...}`` of kinds required, type, range, pattern, enum, length, email, url, uuid."""
    found = []
    for rule in rules:
        c, s = F.col(rule["field"]), F.col(rule["field"]).cast("string")
        bad = {
            "required": lambda: c.isNull() | (F.trim(s) == ""),
            "type": lambda: c.isNotNull() & s.try_cast(rule["type"]).isNull(),
            "range": lambda: ~c.between(rule["min"], rule["max"]),
            "pattern": lambda: ~s.rlike(rule["pattern"]),
            "enum": lambda: ~c.isin(*rule["values"]),
            "length": lambda: ~F.length(s).between(rule.get("min", 0), rule.get("max", 2**31 - 1)),
        }.get(rule["kind"], lambda: ~s.rlike(FORMATS[rule["kind"]]))()
        found.append(F.when(bad, F.lit(f"{rule['field']}:{rule['kind']}")))
    return df.withColumn(name, _errors(found))


COMPLETENESS_FIELDS = ("event_id", "timestamp", "function_id", "execution_phase", "anomaly_type", "duration", "memory_spike_kb",
                       "cpu_utilization", "network_io_bytes", "source")


def completeness(df: DataFrame, fields: Iterable[str] = COMPLETENESS_FIELDS) -> DataFrame:
    fields = sorted(fields)
    miss = _errors([F.lit(f) if f not in df.columns else F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    return df.withColumn("missing_fields", miss).withColumn("completeness", 1 - F.size("missing_fields") / F.lit(float(len(fields))))


# fixed values: suspicious content
SUSPICIOUS = {
    "script": r"(?i)<script[^>]*>", "javascript": "(?i)javascript:", "vbscript": "(?i)vbscript:", "data_html": "(?i)data:text/html", "eval": r"(?i)eval\s*\(",
    "exec": r"(?i)exec\s*\(", "import_os": r"(?i)import\s+os", "dynamic_import": "(?i)__import__", "subprocess": "(?i)subprocess", "shell": "(?i)shell=true",
}


def payload_safety(df: DataFrame, column: str, max_length: int = 10_000, truncate: bool = False) -> DataFrame:
    """Issues of a whole text payload, and the payload with suspicious parts replaced.

    Over-long payloads are reported; they are only cut when ``truncate`` asks for it.
    """
    c = F.col(column)
    issues = [F.when(c.rlike(p), F.lit(n)) for n, p in SUSPICIOUS.items()] + [F.when(F.length(c) > max_length, "too_long")]
    clean = F.substring(c, 1, max_length) if truncate else c
    for p in SUSPICIOUS.values():
        clean = F.regexp_replace(clean, p, "[REMOVED]")
    return df.withColumns({"issues": _errors(issues), "clean": clean}).withColumn(
        "severity", F.expr("CASE WHEN size(array_remove(issues, 'too_long')) > 0 THEN 'critical' WHEN size(issues) > 0 THEN 'warning' ELSE 'none' END"))


def payload_structure(df: DataFrame, id_col: str, column: str, max_depth: int = 10, max_keys: int = 1_000, max_list: int = 1_000, max_string: int = 10_000) -> DataFrame:
    """(id, path, issue, size): where a JSON payload breaks a limit: invalid_json, too_deep, too_many_keys, list_too_long or string_too_long.

    The trees of all payloads are walked level by level as variants. An object or list tells its size itself, and of what it holds only what can still
    break a limit goes on: objects, lists and over-long strings. Nothing is shuffled, and the walk ends when no row is left. What lies deeper than
    ``max_depth`` (the payload itself has depth 0) is reported and not entered, so levels are bounded and nothing recurses. size is the number of
    levels, keys, items or characters found. A null payload has no issues. Paths start at root: root.key[0].
    """
    from faultline.session import cut_lineage

    front = df.select(F.col(id_col).alias("id"), F.lit("root").alias("path"), F.try_parse_json(F.col(column)).alias("v"), F.col(column).isNotNull().alias("given"))
    broken = front.where("given AND v IS NULL").select("id", "path", F.lit("invalid_json").alias("issue"), F.lit(0).cast("bigint").alias("size"))
    front, out, depth = front.where("v IS NOT NULL").select("id", "path", "v"), [broken], 0
    while True:
        if depth > max_depth:
            out.append(front.select("id", "path", F.lit("too_deep").alias("issue"), F.lit(depth).cast("bigint").alias("size")))
            break
        kind = F.schema_of_variant("v")
        typed = front.withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "text"))
        size = (F.when(F.col("kind") == "object", F.size(F.try_variant_get("v", "$", "map<string,variant>"))).when(F.col("kind") == "list", F.size(F.try_variant_get("v", "$", "array<variant>")))
                .otherwise(F.length(F.try_variant_get("v", "$", "string"))).cast("bigint"))
        told = cut_lineage(typed.where("kind IS NOT NULL").withColumn("size", size).where(F.col("kind").isin("object", "list") | (F.col("size") > max_string)))
        issue = F.when(F.col("kind") == "object", "too_many_keys").when(F.col("kind") == "list", "list_too_long").otherwise("string_too_long")
        most = F.when(F.col("kind") == "object", max_keys).when(F.col("kind") == "list", max_list).otherwise(max_string)
        out.append(told.where(F.col("size") > most).select("id", "path", issue.alias("issue"), "size"))
        inner = told.where("kind <> 'text' AND size > 0").select("id", F.col("path").alias("above"), "kind", "v")
        if inner.isEmpty():
            break
        parts = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("kind") == "object", F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        front, depth = parts.select("id", F.concat("above", step).alias("path"), F.col("value").alias("v")), depth + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionAll(part)
    return result


def filter_detections(df: DataFrame, *, severity=None, anomaly_type=None, function=None, since=None, until=None, technique=None,
                      decision=None, risk_band=None, text=None, case_links: DataFrame | None = None, case_status: str | None = None,
                      time: str = "ts_us") -> DataFrame:
    """Detections by any mix of conditions. ``case_status='none'`` keeps rows without a linked case."""
    for col, want in (("decision", decision), ("trace_severity", severity), ("anomaly_type", anomaly_type),
                      ("function_id", function), ("risk_band", risk_band)):
        if want is not None:
            df = df.where(F.col(col) == want)
    if since is not None:
        df = df.where(F.col(time) >= since)
    if until is not None:
        df = df.where(F.col(time) <= until)
    if technique is not None:
        df = df.where(F.array_contains("techniques", technique))
    if text is not None:
        df = df.where(F.lower(F.concat_ws(" ", F.col("event_id").cast("string"), "function_id")).contains(text.lower()))
    if case_status is not None:
        linked = case_links if case_status == "none" else case_links.where(F.col("status") == case_status)
        df = df.join(linked.select("event_id"), "event_id", "left_anti" if case_status == "none" else "left_semi")
    return df
