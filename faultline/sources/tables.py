"""Views over the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.session import prepare

#: microseconds of 2024-01-01T00:00:00Z, the first instant of the event table
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan yields fewer splits than there are cores.

    Text and record pipelines are narrow and heavy on CPU: one small file would keep them on one
    core. Real inputs have more splits than cores and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocation telemetry derived from the event table, one row per event.

    Time runs 60 times faster than in the source, so five-minute frames hold several rows.
    """
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(ev: DataFrame) -> DataFrame:
    """The same projection over any event frame, batch or stream."""
    err = F.col("event_type") == "error"
    phase = F.when(F.col("event_type") == "signup", "init").when(
        F.col("event_type") == "purchase", "shutdown"
    ).when(err, "error").otherwise("invoke")
    kind = (
        F.when(err & (F.col("event_id") % 3 == 0), "timeout_fallback")
        .when(err, "execution_failure")
        .when(F.col("event_id") % 17 == 0, "memory_spike")
        .when(F.col("event_id") % 23 == 0, "data_exfiltration")
        .otherwise("benign")
    )
    return ev.select(
        "event_id",
        F.concat(F.lit("fn_"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("function_id"),
        F.expr(f"(unix_micros(cast(ts AS timestamp)) - {EPOCH_US}) DIV 60").alias("ts_us"),
        phase.alias("execution_phase"),
        kind.alias("anomaly_type"),
        (F.col("value") / 10.0).alias("duration"),
        (F.get_json_object("props", "$.k").cast("bigint") * 2048).alias("memory_spike_kb"),
        ((F.col("event_id") * 37) % 101).cast("double").alias("cpu_utilization"),
        (((F.col("event_id") * 7919) % 1000) * 65536).alias("network_io_bytes"),
    )


def scored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``telemetry`` with the score and context columns of a full record, derived from the id and the measures."""
    return spread(telemetry(spark, sf_dir)).withColumns({
        "adversarial_score": F.expr("event_id % 11 / 20D"),
        "economic_risk_score": F.col("cpu_utilization") / 200,
        "silent_failure_probability": F.expr("event_id % 10 / 20D"),
        "completeness_score": F.expr("1 - event_id % 7 / 20D"),
        "confidence_level": F.expr("1 - event_id % 5 / 20D"),
        "fallback_mode": F.expr("event_id % 13 = 0"),
        "trigger_type": F.expr("CASE WHEN event_id % 2 = 0 THEN 'http' END"),
        "source": F.lit("primary"),
        "causal_depth": F.expr("event_id % 4"),
        "parent_chain": F.expr("CASE WHEN event_id % 3 = 0 THEN array('a', 'b') ELSE array() END"),
    })
