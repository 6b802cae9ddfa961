"""Readers and writers of the file formats records come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.operators.records import normalise_event
from faultline.schema import TELEMETRY_SCHEMA


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw invocation events, one JSON document per file; the whole text stays as ``raw``."""
    return normalise_event(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))


def read_labelled(spark: SparkSession, path: str, parallelism: int | None = None) -> DataFrame:
    """(Gzipped) JSON array of records with a label. Gzip cannot be split, so the rows are spread afterwards."""
    df = spark.read.schema(TELEMETRY_SCHEMA).json(path, multiLine=True)
    df = df.repartition(parallelism) if parallelism else df
    return df.withColumn("label", F.col("anomaly_type") != "benign")


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat log with a header."""
    schema = """anomaly_type string, concurrency_id string, duration double, event_id string, execution_phase string, fallback_mode boolean,
        function_profile_id string, log_version string, memory_spike_kb bigint, source string, timestamp double"""
    return spark.read.csv(path, header=True, schema=schema).withColumnRenamed("function_profile_id", "function_id")


def write_traces(df: DataFrame, path: str, trace: str = "trace_id", buckets: int = 64, mode: str = "append") -> None:
    """Traces by dataset and hash bucket, so that one trace is found in one folder and a hot dataset is spread."""
    out = df.withColumn("trace_bucket", F.pmod(F.xxhash64(trace), F.lit(buckets)).cast("int"))
    out.write.mode(mode).partitionBy("dataset", "trace_bucket").parquet(path)


def read_traces(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("dataset") == dataset) if dataset else df


def write_report(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(kind).save(path)
