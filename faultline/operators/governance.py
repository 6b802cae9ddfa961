"""Consent and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_consent(log: DataFrame, as_of: int, subject: str = "subject", policy: str = "policy") -> DataFrame:
    """Latest consent per subject and policy by ``granted_at`` among those granted up to ``as_of``: withdrawn wins, expired becomes unknown."""
    last = log.where(F.col("granted_at") <= as_of).groupBy(subject, policy).agg(F.max(F.struct("granted_at", "status", "expires_at")).alias("c"))
    state = F.when(F.col("c.status") == "withdrawn", "withdrawn").when(F.col("c.expires_at") < as_of, "unknown").otherwise(F.col("c.status"))
    return last.select(subject, policy, state.alias("consent"))


def apply_consent(records: DataFrame, consents: DataFrame, fields: dict[str, Column], policy: str, explicit: bool = True, subject: str = "subject") -> DataFrame:
    """Redact the given fields of a regulation. One that needs explicit consent and lacks it is reported, and not applied."""
    c = consents.where(F.col("policy") == policy).select(subject, "consent")
    out = records.join(c, subject, "left").withColumn("consent", F.coalesce("consent", F.lit("unknown")))
    bad = (F.col("consent") != "granted") if explicit else F.lit(False)
    out = out.withColumn("violation", bad)
    return out.withColumns({f: F.when(F.col("violation"), F.col(f)).otherwise(clean) for f, clean in fields.items()})


def audit_filter(events: DataFrame, *, level=None, category=None, action=None, since=None, until=None, time: str = "ts_us") -> DataFrame:
    for col, want in (("level", level), ("category", category), ("action", action)):
        if want is not None:
            events = events.where(F.col(col) == want)
    if since is not None:
        events = events.where(F.col(time) >= since)
    return events.where(F.col(time) <= until) if until is not None else events


def audit_summary(events: DataFrame) -> DataFrame:
    """Counts by level, category, action and component as (kind, name, n), in one pass over the log."""
    kinds = ("level", "category", "action", "component")
    long = events.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds])))
    return long.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def audit_totals(events: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return events.agg(F.count(F.lit(1)).alias("events"), n("level IN ('error', 'critical')").alias("errors"), n("level = 'warning'").alias("warnings"),
                      n("category = 'security'").alias("security"), n("category = 'compliance'").alias("compliance"), F.avg("duration").alias("mean_duration"))
