"""Content hashes, signatures and payload hashes over canonical JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from faultline.functions.text import hmac_sha256

# --- fixed values: what a record's content hash covers, and the keys a payload hash leaves out ---
CONTENT_FIELDS = ("anomaly_type", "cpu_utilization", "duration", "event_id", "execution_phase", "function_id", "memory_spike_kb", "network_io_bytes", "source", "timestamp")
VOLATILE = ("timestamp", "correlation_id", "request_id")


def canonical_hash(fields: Iterable[str]) -> Column:
    """SHA-256 of the JSON object of the fields, keys sorted, without spaces, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def sign(df: DataFrame, key: str, fields: Iterable[str] = CONTENT_FIELDS) -> DataFrame:
    """Adds content_hash and signature (HMAC-SHA256 of the hash); all ``fields`` must be there."""
    signed = df.withColumn("content_hash", canonical_hash(fields))
    return signed.withColumn("signature", hmac_sha256(F.col("content_hash"), key))


def verify(df: DataFrame, key: str, fields: Iterable[str] = CONTENT_FIELDS) -> DataFrame:
    """Adds verified and fault: missing, hash_mismatch (the content has changed) or bad_signature."""
    fault = (F.when(F.col("content_hash").isNull() | F.col("signature").isNull(), "missing").when(canonical_hash(fields) != F.col("content_hash"), "hash_mismatch")
             .when(hmac_sha256(F.col("content_hash"), key) != F.col("signature"), "bad_signature"))
    return df.withColumn("fault", fault).withColumn("verified", F.col("fault").isNull())


def broken(key: str, fields: Iterable[str] = CONTENT_FIELDS) -> dict[str, Column]:
    """The two faults of a signed record as conditions of their own; an absent or empty hash or signature is no fault."""
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return {"hash_mismatch": held("content_hash") & (canonical_hash(fields) != F.col("content_hash")),
            "bad_signature": held("signature") & (hmac_sha256(F.coalesce(F.col("content_hash"), F.lit("")), key) != F.col("signature"))}


def payload_hash(columns: Iterable[str], exclude: Iterable[str] = VOLATILE) -> Column:
    """Hash of a payload's columns without its volatile ones."""
    left = set(columns) - set(exclude)
    return canonical_hash(left)


def behavioural_signature(df: DataFrame, columns: Iterable[str], first: int = 5) -> Column:
    """First 16 digits of the MD5 of ``key:value`` for the first keys in order: numbers to two places, others by their type."""
    parts = []
    for c in sorted(columns)[:first]:
        kind = df.schema[c].dataType
        value = F.format_string("%.2f", F.col(c).cast("double")) if isinstance(kind, T.NumericType) else F.lit(kind.simpleString())
        parts.append(F.concat(F.lit(f"{c}:"), value))
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)
