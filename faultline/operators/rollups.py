"""Rollups of detections, cases and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

RANK = {"observe": 0, "review": 1, "escalate": 2}
_SEV = F.expr


def function_rollup(det: DataFrame, time: str = "ts_us") -> DataFrame:
    return det.groupBy("function_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decision") == s).alias(s) for s in RANK],
                                          F.max(time).alias("last_seen"))


def technique_counts(det: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return det.select(*by, F.explode("techniques").alias("technique")).groupBy(*by, "technique").agg(F.count(F.lit(1)).alias("hits"))


def recent_detections(det: DataFrame, n: int = 5, key: str = "function_id", time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Latest ``n`` per key. The limit is applied before the shuffle too: Spark keeps n per task first."""
    w = W.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return det.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def bin_seconds(window_s: float) -> int:
    """Bin width by window length: 1 h up to a day, 6 h up to a week, 1 d up to 30 days, else 3 d."""
    return 3600 if window_s <= 86400 else 21600 if window_s <= 7 * 86400 else 86400 if window_s <= 30 * 86400 else 3 * 86400


def histogram(det: DataFrame, since: int, until: int, bin_s: int | None = None, time: str = "ts_us") -> DataFrame:
    """Detections per bin, empty bins included."""
    width = (bin_s or bin_seconds((until - since) / 1e6)) * 1_000_000
    bins = det.sparkSession.range(since // width, (until - 1) // width + 1).select((F.col("id") * width).alias("bucket_start"))
    counts = det.where(F.col(time).between(since, until - 1)).groupBy((F.expr(f"{time} DIV {width}") * width).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bucket_start", "left").select("bucket_start", F.coalesce("n", F.lit(0)).alias("n"))


def threat_map(det: DataFrame) -> DataFrame:
    """Hits per tactic and technique, with subtotals per tactic and a grand total."""
    pairs = det.select(F.explode(F.arrays_zip("tactics", "techniques")).alias("x")).select(F.col("x.tactics").alias("tactic"), F.col("x.techniques").alias("technique"))
    return pairs.rollup("tactic", "technique").agg(F.count(F.lit(1)).alias("hits"))


def inbox_summary(det: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts by severity, technique and case status as (kind, name, n)."""
    status = det.join(cases.select("event_id", "status"), "event_id", "left").groupBy(F.coalesce("status", F.lit("none")).alias("name"))
    return (det.groupBy(F.col("decision").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("severity").alias("kind"), "name", "n")
            .unionByName(technique_counts(det).select(F.lit("technique").alias("kind"), F.col("technique").alias("name"), F.col("hits").alias("n")))
            .unionByName(status.agg(F.count(F.lit(1)).alias("n")).select(F.lit("case_status").alias("kind"), "name", "n")))


def case_rollup(links: DataFrame, det: DataFrame) -> DataFrame:
    """Highest severity and number of linked detections per case."""
    order = F.expr("CASE decision WHEN 'escalate' THEN 2 WHEN 'review' THEN 1 ELSE 0 END")
    return links.join(det.select("event_id", "decision"), "event_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("detections"), F.max_by("decision", order).alias("max_severity"))


def experiment_summary(experiments: DataFrame, results: DataFrame, models: DataFrame, key: str, score: str, fan_out: bool = False) -> DataFrame:
    """Number of metrics and models and best score per experiment, each side aggregated before the join.

    ``fan_out`` multiplies the two counts, as two plain left joins would.
    """
    a = results.groupBy(key).agg(F.count(F.lit(1)).alias("num_metrics"))
    b = models.groupBy(key).agg(F.count(F.lit(1)).alias("num_models"), F.max(score).alias("best_score"))
    out = experiments.join(a, key, "left").join(b, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("num_metrics", "num_models")})
    if fan_out:
        x, y = F.col("num_metrics"), F.col("num_models")
        out = out.withColumns({"num_metrics": x * F.greatest(y, F.lit(1)), "num_models": y * F.greatest(x, F.lit(1))})
    return out


def model_comparison(models: DataFrame, name: str, values: list[str]) -> DataFrame:
    return models.groupBy(name).agg(F.count(F.lit(1)).alias("num_experiments"), *[F.avg(v).alias(f"avg_{v}") for v in values], F.stddev_samp(values[0]).alias(f"std_{values[0]}"))
