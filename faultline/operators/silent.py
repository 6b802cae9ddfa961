"""Silent-failure checks of input and output payloads held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: rules by kind of function ---
FUNCTION_RULES = {
    "ml_inference": {"required": ["prediction", "confidence"], "range": ("confidence", 0.0, 1.0)},
    "auth_service": {"required": ["status", "user_id"], "allowed": ("status", ["ok", "denied", "error"])},
    "billing_service": {"required": ["amount", "currency"], "allowed": ("currency", ["USD", "EUR", "GBP"]), "minimum": ("amount", 0.0)},
}
# --- fixed values: weights of the six signals ---
WEIGHTS = {"consistency": 0.22, "function": 0.22, "invariant": 0.18, "corruption": 0.18, "trace": 0.10, "sanity": 0.10}
NOT_FINITE = r"(?i)\b(NaN|-?Infinity)\b"


def _get(c: str, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}")


def io_consistency(out: str) -> Column:
    """Confidence of the output as such; below 0.5 it is inconsistent."""
    return (F.when(F.col(out).isNull(), 0.05).when(~F.trim(out).startswith("{"), 0.1).when(F.col(out).rlike(NOT_FINITE), 0.2)
            .when(F.trim(out) == "{}", 0.25).when(F.length(out) > 2_000_000, 0.4).otherwise(0.7))


def function_rules(kind: str, out: str, rules: dict | None = None) -> Column:
    """Confidence under the rules of the function's kind; below 0.5 a rule is broken."""
    result = F.lit(0.75)
    for name, rule in (rules or FUNCTION_RULES).items():
        check = F.when(F.greatest(*[_get(out, k).isNull() for k in rule.get("required", [])]), 0.3)
        if "range" in rule:
            k, lo, hi = rule["range"]
            v = _get(out, k).try_cast("double")
            check = check.when(_get(out, k).isNotNull() & F.coalesce(~v.between(lo, hi), F.lit(True)), 0.35)
        if "allowed" in rule:
            k, values = rule["allowed"]
            check = check.when(~_get(out, k).isin(*values), 0.4)
        if "minimum" in rule:
            k, lo = rule["minimum"]
            v = _get(out, k).try_cast("double")
            check = check.when(_get(out, k).isNotNull() & F.coalesce(v < lo, F.lit(True)), 0.4)
        result = F.when(F.col(kind) == name, check.otherwise(0.75)).otherwise(result)
    return result


def trace_semantics(times: Column, phases: Column, duration: Column, limit: float = 60.0) -> Column:
    """Monotonic timestamps, phase order INIT, INVOKE, TEARDOWN, and a sane duration."""
    code = F.transform(phases, lambda p: F.when(p == "INIT", 0).when(p == "INVOKE", 1).when(p == "TEARDOWN", 2).otherwise(99))
    return (F.when(times != F.array_sort(times), 0.4).when(code != F.array_sort(code), 0.45)
            .when(duration < 0, 0.4).when(duration > limit, 0.45).otherwise(0.65))


def invariants(inp: str, out: str, preserve: list[str] | None = None, monotonic: str | None = None, extra: dict[str, tuple[float, str]] | None = None) -> Column:
    """Weighted share of passed invariants: echoed id (.35), input hash if claimed (.30), and configured ones.

    ``extra`` registers more: name -> (weight, SQL condition).
    """
    echo = F.coalesce(_get(inp, "correlation_id") == F.coalesce(_get(out, "correlation_id"), _get(out, "corr_id"), _get(out, "request_id")), F.lit(False))
    claimed = F.coalesce(_get(out, "input_hash"), F.lit(""))
    parts = [(0.35, echo), (0.30, (claimed == "") | (claimed == F.sha2(F.col(inp), 256)))]
    parts += [(w, F.coalesce(F.expr(c), F.lit(False))) for w, c in (extra or {}).values()]
    mean = sum(w for w, _ in parts) / len(parts)
    if monotonic:
        parts.append((mean, F.coalesce(_get(out, monotonic).try_cast("double") >= 0, F.lit(False))))
    if preserve:
        same = F.lit(True)
        for k in preserve:
            same = same & _get(inp, k).eqNullSafe(_get(out, k))
        parts.append((mean, same))
    got = F.lit(0.0)
    for w, ok in parts:
        got = got + F.when(ok, w).otherwise(0.0)
    return got / sum(w for w, _ in parts)


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def corruption(out: str, in_numbers: Column, out_numbers: Column, z_limit: float = 6.0) -> Column:
    """Score from 1 down: declared hash mismatch (.4), robust shift of the output's median against the input."""
    declared = F.coalesce(_get(out, "output_hash"), F.lit(""))
    bad_hash = (declared != "") & (declared != F.sha2(F.coalesce(_get(out, "data"), F.lit("")), 256))
    med = _median(in_numbers)
    mad = F.coalesce(F.nullif(_median(F.transform(in_numbers, lambda v: F.abs(v - med))), F.lit(0.0)), F.lit(1e-9))
    z = F.abs(_median(out_numbers) - med) / (1.4826 * mad)
    enough = (F.size(in_numbers) >= 5) & (F.size(out_numbers) >= 5)
    shift = F.when(enough & (z > z_limit), F.greatest(F.lit(0.25), 1 - 0.5 * F.least(F.lit(1.0), z / 10))).otherwise(1.0)
    return F.least(F.when(bad_hash, 0.4).otherwise(1.0), shift)


def failure_probability(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``consistency``, ``function`` and ``trace`` count as 0 below one half; then 0.15 + 0.85 * weighted risk."""
    w = weights or WEIGHTS
    raw = F.lit(0.0)
    for name, weight in w.items():
        good = F.when(F.col(name) >= 0.5, F.col(name)).otherwise(0.0) if name in ("consistency", "function", "trace") else F.col(name)
        raw = raw + weight * (1 - good)
    return df.withColumn("failure_probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.15 + 0.85 * raw)))
