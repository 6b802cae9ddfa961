"""Schema versions: detection, migration, comparison, coercion, evolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# --- fixed values: fields of the known versions with their JSON types, and those a record may lack ---
VERSIONS = {
    "v1.0": {"id": "string", "timestamp": "integer", "function": "string", "phase": "string", "data": "object", "version": "string"},
    "v2.0": {"record_id": "string", "timestamp": "number", "function_name": "string", "execution_phase": "string", "anomaly_type": "string", "telemetry_data": "object", "schema_version": "string"},
    "v2.1": {"record_id": "string", "timestamp": "number", "function_name": "string", "execution_phase": "string", "anomaly_type": "string", "telemetry_data": "object",
             "provenance_chain": "object", "context_metadata": "object", "schema_version": "string"},
    "v2.2": {"record_id": "string", "timestamp": "number", "function_name": "string", "execution_phase": "string", "anomaly_type": "string", "anomaly_confidence": "number", "telemetry_data": "object",
             "provenance_chain": "object", "context_metadata": "object", "behavioral_signature": "string", "risk_score": "number", "schema_version": "string"},
}
OPTIONAL = {"v1.0": ["version"], "v2.0": ["schema_version"], "v2.1": ["provenance_chain", "context_metadata"],
            "v2.2": ["anomaly_confidence", "provenance_chain", "context_metadata", "behavioral_signature", "risk_score"]}
# JSON types by what Spark calls them in a variant
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*"}
# --- fixed values: confidence and base risk by class; namespace of derived ids ---
CONFIDENCE = {"benign": 0.9, "suspicious": 0.6, "malicious": 0.8, "unknown": 0.3}
RISK = {"benign": 10.0, "suspicious": 50.0, "malicious": 90.0, "unknown": 30.0}
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) by slicing a SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def detect_version(df: DataFrame, raw: str = "raw", least: float = 0.7) -> DataFrame:
    """schema_version and match of a JSON record.

    A ``schema_version`` field decides, then a ``version`` field. Else the best matching version whose required fields
    are all there: 0.6 of the share of its fields present plus 0.4 of the share of those with the right JSON type; the
    earlier version wins a tie, and below ``least`` there is none.
    """
    keys, parsed = F.json_object_keys(raw), F.try_parse_json(raw)
    scores = []
    for i, (v, fields) in enumerate(VERSIONS.items()):
        need = F.array(*[F.lit(f) for f in fields if f not in OPTIONAL[v]])
        common = F.size(F.array_intersect(keys, F.array(*[F.lit(f) for f in fields])))
        typed = F.lit(0)
        for f, kind in fields.items():
            typed = typed + F.coalesce(F.schema_of_variant(F.variant_get(parsed, f"$.{f}", "variant")).rlike(f"^({KINDS[kind]})$"), F.lit(False)).cast("int")
        score = F.when(F.size(F.array_except(need, keys)) == 0, 0.6 * common / len(fields) + 0.4 * typed / F.greatest(common, F.lit(1))).otherwise(0.0)
        scores.append(F.struct(F.round(score, 9).alias("s"), F.lit(-i).alias("i"), F.lit(v).alias("v")))
    best = F.array_max(F.array(*scores))
    explicit, old = F.get_json_object(raw, "$.schema_version"), F.get_json_object(raw, "$.version")
    found = F.coalesce(explicit, F.when(old.startswith("v"), old).otherwise(F.concat(F.lit("v"), old)), F.when(best["s"] >= least, best["v"]))
    return df.withColumns({"schema_version": found, "match": best["s"]})


def _v1_to_v2(c: dict[str, Column]) -> dict[str, Column]:
    phase = F.coalesce(F.create_map(*[F.lit(x) for kv in {"init": "initialization", "exec": "execution", "complete": "completion", "error": "error"}.items() for x in kv])[c["phase"]], F.lit("execution"))
    return {"record_id": F.coalesce(c["id"], F.lit("")), "timestamp": F.coalesce(c["timestamp"], F.lit(0.0)), "function_name": F.coalesce(c["function"], F.lit("")),
            "execution_phase": phase, "anomaly_type": F.lit("unknown"), "telemetry_data": F.coalesce(c["data"], F.lit("{}"))}


def _v20_to_v21(c: dict[str, Column]) -> dict[str, Column]:
    return {**c, "record_id": F.when(c["record_id"].rlike(UUID), c["record_id"]).otherwise(uuid5(c["record_id"])), "provenance_chain": F.lit(None).cast("string"), "context_metadata": F.lit(None).cast("string")}


def _v21_to_v22(c: dict[str, Column]) -> dict[str, Column]:
    pick = lambda m, d: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[c["anomaly_type"]], F.lit(d))
    conf = pick(CONFIDENCE, 0.5)
    return {**c, "anomaly_confidence": conf, "behavioral_signature": F.substring(F.md5(c["telemetry_data"]), 1, 16), "risk_score": pick(RISK, 30.0) * conf}


def _v21_to_v20(c: dict[str, Column]) -> dict[str, Column]:
    return {k: v for k, v in c.items() if k not in ("provenance_chain", "context_metadata")}


STEPS = {("v1.0", "v2.0"): _v1_to_v2, ("v2.0", "v2.1"): _v20_to_v21, ("v2.1", "v2.2"): _v21_to_v22, ("v2.1", "v2.0"): _v21_to_v20}


def migration_path(start: str, goal: str) -> list[str]:
    """Shortest chain of versions from start to goal; empty if there is none."""
    paths = [[start]]
    while paths:
        path = paths.pop(0)
        if path[-1] == goal:
            return path
        paths += [[*path, b] for a, b in STEPS if a == path[-1] and b not in path]
    return []


def migrate(df: DataFrame, start: str, goal: str) -> DataFrame:
    """Whole migration as one projection: the steps compose as column expressions."""
    path = migration_path(start, goal)
    if not path:
        raise ValueError(f"no migration from {start} to {goal}")
    cols = {f: F.col(f) for f in VERSIONS[start] if f not in ("version", "schema_version")}
    for a, b in zip(path, path[1:]):
        cols = STEPS[(a, b)](cols)
    return df.select(*[c.alias(n) for n, c in cols.items()], F.lit(goal).alias("schema_version"))


def schema_diff(old: T.StructType, new: T.StructType) -> dict:
    """Added, removed, retyped fields and changed nullability; breaking unless only widened or optional fields are added."""
    a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    both = a.keys() & b.keys()
    retyped = {n: (a[n].dataType.simpleString(), b[n].dataType.simpleString()) for n in sorted(both) if a[n].dataType != b[n].dataType}
    widened = {n for n, t in retyped.items() if t in {("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double")}}
    required = sorted(n for n in both if a[n].nullable and not b[n].nullable)
    out = {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "retyped": retyped, "now_required": required}
    out["breaking"] = bool(out["removed"] or set(retyped) - widened or required or [n for n in out["added"] if not b[n].nullable])
    return out


def coerce(df: DataFrame, target: T.StructType) -> DataFrame:
    """Project to the target: cast, null on failure, drop unknown fields, null for missing ones."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast("string").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields])


def profile_keys(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Key, value kind and count over JSON records: the evidence schema evolution needs."""
    pairs = df.select(F.explode(F.from_json(raw, "map<string,string>")).alias("key", "value"))
    kind = (F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?\d+$"), "integer").when(F.col("value").try_cast("double").isNotNull(), "number")
            .when(F.col("value").isin("true", "false"), "boolean").otherwise("string"))
    return pairs.groupBy("key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def evolve(profile: DataFrame, known: dict[str, str]) -> DataFrame:
    """Proposals: add unknown keys, widen integer to number or anything mixed to string."""
    order = F.expr("CASE kind WHEN 'null' THEN 0 WHEN 'boolean' THEN 1 WHEN 'integer' THEN 2 WHEN 'number' THEN 3 ELSE 4 END")
    seen = profile.groupBy("key").agg(F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))).alias("kinds"), F.max_by("kind", order).alias("top"), F.sum("n").alias("records"))
    want = F.when(F.size("kinds") <= 1, F.col("top")).when(F.array_contains("kinds", "string") | F.array_contains("kinds", "boolean"), "string").otherwise("number")
    now = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("key")]
    out = seen.select("key", want.alias("kind"), "records", now.alias("current"))
    action = F.when(F.col("current").isNull(), "ADD_FIELD").when((F.col("current") != F.col("kind")) & ~((F.col("current") == "number") & (F.col("kind") == "integer")) & (F.col("current") != "string"), "WIDEN_TYPE")
    return out.withColumn("action", action).where("action IS NOT NULL")
