"""Column functions on strings: sanitising, redaction, personal data, keyed hashes.

All of it is Catalyst expressions except Unicode NFKC and BLAKE2b, which Spark lacks; those two
are small Arrow UDFs.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# --- fixed values: sanitising patterns ---
ZERO_WIDTH = "[​‌‍‎‏‪-‮﻿⁠-⁤]"
SHELL_META = r"[;&|$`]"
SQL_WORDS = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|UNION|EXEC)\b"
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# --- fixed values: intake redaction ---
INTAKE_KEYS = (r"(?i)email|phone|mobile|ssn|passport|credit.?card|bank.?account|\bip\b|ip_addr|password|api.?key|token|secret"
               r"|dob|date_of_birth|full.?name|first.?name|last.?name")
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
LOOSE_PHONE = r"\+?\d[\d\-\s]{6,}\d"
LOOSE_CARD = r"\b(?:\d[ \-]?){15,16}\b"

# --- fixed values: personal data patterns by name ---
PATTERNS = {
    "email": r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+\d{1,3}[\s\-]?\d[\d\s\-]{6,12}\d|\b\d{3}[\s\-]\d{3}[\s\-]\d{4}\b|\b\d{4}[\s\-]\d{6}\b)",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "credit_card": r"\b(?:\d[ \-]?){13,18}\d\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "ipv6": (r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7}"
             r"|::(?:[fF]{4}:){0,1}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)){3}"),
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{8,30}\b",
    "dob": r"\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}\b|\b\d{2}[-/]\d{2}[-/](?:19|20)\d{2}\b",
    "nhs": r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b",
    "icd10": r"\b[A-Z]\d{2}\.\d{1,4}\b",
}
# a character every match of the pattern contains
HINTS = {"email": "@", "ssn": "-", "ipv4": ".", "ipv6": ":", "icd10": "."}
# --- fixed values: patterns of each regime, in the order they are applied ---
REGIMES = {
    "gdpr": ("email", "phone", "ssn", "credit_card", "ipv4", "ipv6", "iban", "dob", "nhs"),
    "ccpa": ("email", "phone", "ssn", "credit_card", "ipv4", "ipv6", "iban", "dob", "nhs"),
    "hipaa": ("email", "ssn", "icd10", "nhs", "dob", "credit_card"),
}
# --- fixed values: detection rules, name -> (type, pattern, confidence) ---
RULES = {
    "email_basic": ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9),
    "phone_us": ("phone", r"(?i)\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b", 0.85),
    "ssn_us": ("ssn", r"(?i)\b\d{3}[-]?\d{2}[-]?\d{4}\b", 0.95),
    "credit_card": ("credit_card", r"(?i)\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0.9),
    "ip_address": ("ip_address", r"(?i)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.8),
    "aws_access_key": ("aws_access_key", r"(?i)\bAKIA[0-9A-Z]{16}\b", 0.95),
    "aws_secret_key": ("aws_secret_key", r"(?i)\b[A-Za-z0-9/+=]{40}\b", 0.7),
}


@F.pandas_udf(T.StringType())
def _nfkc(v: pd.Series) -> pd.Series:
    import unicodedata

    return v.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def normalise_unicode(text: Column) -> Column:
    """NFKC without zero-width characters. Plain ASCII text is not sent to Python."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(F.regexp_replace(_nfkc(odd), ZERO_WIDTH, ""), text)


def strip_shell(text: Column) -> Column:
    return F.regexp_replace(text, SHELL_META, "")


def escape_html(text: Column) -> Column:
    """Drop script blocks, then escape markup."""
    v = F.regexp_replace(text, SCRIPT, "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        v = F.replace(v, F.lit(raw), F.lit(safe))
    return v


def strip_control(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, CONTROL, ""))


def sanitise(df, column: str, out: str = "sanitised", flags: str = "flags"):
    """The chain Unicode -> shell -> markup -> SQL check; adds the clean text and the fired steps."""
    df = df.withColumn("_s1", normalise_unicode(F.col(column)))
    df = df.withColumn("_s2", strip_shell(F.col("_s1")))
    df = df.withColumn(out, F.when(F.col("_s2").rlike('[<>"]'), escape_html(F.col("_s2"))).otherwise(F.col("_s2")))
    fired = F.array_compact(F.array(
        F.when(F.col("_s1") != F.col(column), "unicode"), F.when(F.col("_s2") != F.col("_s1"), "command"),
        F.when(F.col(out) != F.col("_s2"), "html"), F.when(F.col(out).rlike(SQL_WORDS), "sql")))
    return df.withColumn(flags, fired).drop("_s1", "_s2")


def sanitise_path(path: Column) -> Column:
    """Relative path without ``.``, ``..`` and backslashes."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), lambda acc, p: F.when(
        p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    joined = F.array_join(kept, "/")
    return F.when(joined != "", joined).when(path.startswith("/"), "").otherwise(".")


def sanitise_url(url: Column) -> Column:
    """http and https only, host in lower case, no credentials; other schemes give ''."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), "^.*@", ""))
    rest = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(.*)$", 1)
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, rest)).otherwise("")


def redact_intake(text: Column) -> Column:
    v = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")).otherwise(text)  # searching costs most where there is none
    v = F.regexp_replace(v, LOOSE_PHONE, "[REDACTED_PHONE]")
    # no pattern matches without a digit or an at sign
    return F.when(text.rlike("[0-9@]"), F.regexp_replace(v, LOOSE_CARD, "[REDACTED_CARD]")).otherwise(text)


def redact_struct(kind: T.StructType, path: str, copy: str) -> tuple[Column, list[Column]]:
    """Redacted copy of struct column ``path``, and per leaf its path when column ``copy`` holds a changed one.

    Key names are judged while planning, so only string leaves cost anything at run time. The
    copy is to be added as a column first, so that nothing is replaced twice.
    """
    import re

    hits: list[Column] = []

    def walk(k: T.StructType, at: str) -> Column:
        fields = []
        for f in k.fields:
            here = f"{at}.{f.name}"
            if re.search(INTAKE_KEYS, f.name):
                fields.append(F.lit("[REDACTED]").alias(f.name))
                hits.append(F.lit(here))
            elif isinstance(f.dataType, T.StructType):
                fields.append(walk(f.dataType, here).alias(f.name))
            elif isinstance(f.dataType, T.StringType):
                fields.append(redact_intake(F.col(here)).alias(f.name))
                hits.append(F.when(F.col(copy + here[len(path):]) != F.col(here), F.lit(here)))
            else:
                fields.append(F.col(here).alias(f.name))
        return F.struct(*fields)

    return walk(kind, path), hits


def luhn_valid(number: Column) -> Column:
    """Luhn check over the digits of ``number``; fewer than 13 digits fail."""
    digits = F.split(F.reverse(F.regexp_replace(number, r"\D", "")), "")
    total = F.aggregate(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(
            i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).otherwise(d.cast("int")).cast("int")),
        F.lit(0), lambda a, x: a + x)
    return (F.length(F.regexp_replace(number, r"\D", "")) >= 13) & (total % 10 == 0)


def _swap(new: Column):
    return lambda t, raw: F.replace(t, raw, new)


def _pseudonym(t: Column, raw: Column) -> Column:
    return F.replace(t, raw, F.concat(F.lit("[PSEUDO:"), F.substring(F.sha2(raw, 256), 1, 16), F.lit("]")))


def privacy_filter(df, column: str, regime: str = "gdpr", out: str = "filtered", critical: bool = False):
    """Replace personal data by regime; adds the text and ``actions`` (pattern -> replacements).

    ``critical`` columns are pseudonymised by hash instead of redacted, so equal values stay equal.
    """
    df = df.withColumn("_v", F.col(column))
    names = REGIMES[regime]
    for name in names:
        pattern = PATTERNS[name]
        found = F.regexp_extract_all("_v", F.lit(pattern), F.lit(0))
        if name in HINTS:  # texts without the pattern's fixed character are not searched
            found = F.when(F.contains("_v", F.lit(HINTS[name])), found).otherwise(F.expr("CAST(array() AS array<string>)"))
        if name == "credit_card":
            found = F.filter(found, luhn_valid)
        df = df.withColumn("_m", found)
        if critical or name == "credit_card":
            tag = F.lit(f"[REDACTED_{name.upper()}]")
            text = F.aggregate(F.array_distinct("_m"), F.col("_v"), _pseudonym if critical else _swap(tag))
        else:
            text = F.when(F.size("_m") > 0, F.regexp_replace("_v", pattern, f"[REDACTED_{name.upper()}]")).otherwise(F.col("_v"))
        df = df.withColumns({f"_n_{name}": F.size("_m"), "_v": text})
    counts = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"_n_{n}"))])
    return df.withColumns({out: F.col("_v"), "actions": F.map_filter(counts, lambda _, n: n > 0)}).drop(
        "_v", "_m", *[f"_n_{n}" for n in names])


def detect_spans(text: Column, rules: dict | None = None) -> Column:
    """All matches as array<struct<start, pii_type, rule, value, confidence>>, start counted from 0."""
    return F.concat(*[_spans_of(text, rule, *spec) for rule, spec in (rules or RULES).items()])


def _spans_of(text: Column, rule: str, kind: str, pattern: str, confidence: float) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(found, lambda m, i: F.struct(
        (total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))).alias("start"),
        F.lit(kind).alias("pii_type"), F.lit(rule).alias("rule"), m.alias("value"), F.lit(confidence).alias("confidence")))


def redact_spans(text: Column, spans: Column, policy: str = "mask") -> Column:
    """Apply one redaction policy to detected spans, last span first; spans that overlap are covered as one."""
    def cover(s: Column) -> Column:
        v, n = s["value"], F.length(s["value"])
        if policy == "hash":
            return F.concat(F.lit("[HASH:"), F.substring(F.sha2(v, 256), 1, 16), F.lit("]"))
        if policy == "remove":
            return F.lit("[REMOVED]")
        if policy == "encrypt":
            return F.concat(F.lit("[ENCRYPTED:"), F.substring(F.base64(F.encode(v, "UTF-8")), 1, 16), F.lit("...]"))
        if policy == "partial_mask":
            return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
                F.concat(F.substring(v, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(v, F.lit(2))))
        return F.repeat(F.lit("*"), n)

    bounds = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"))))
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    merged = F.aggregate(bounds, F.slice(bounds, 1, 0), lambda acc, s: F.when(
        (F.size(acc) == 0) | (last(acc)["end"] <= s["start"]), F.array_append(acc, s)).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))))
    whole = F.transform(merged, lambda s: F.struct(s["start"].alias("start"), F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("value")))
    return F.aggregate(F.reverse(whole), text, lambda t, s: F.overlay(t, cover(s), s["start"] + 1, F.length(s["value"])))


def mask_value(value: Column, strategy: str = "mask", partial: bool = False) -> Column:
    """Redaction of a whole value; ``partial`` keeps its first two characters.

    Masked e-mails keep the domain, masked numbers the last four digits. The tags and lengths are fixed values.
    """
    n = F.length(value)
    head, rest = F.substring(value, 1, 2), F.substring(value, 3, 1 << 30)
    if strategy == "hash":
        return F.concat(head, F.substring(F.md5(rest), 1, 8)) if partial else F.substring(F.sha2(value, 256), 1, 16)
    if strategy == "pseudonymize":
        return F.concat(F.lit("PSEUDO_"), head, F.lit("_"), F.substring(F.sha1(rest), 1, 6)) if partial else F.concat(F.lit("PSEUDO_"), F.substring(F.sha1(value), 1, 12))
    if strategy == "anonymize":
        return F.concat(F.lit("ANON_"), head, F.lit("_"), F.substring(F.md5(rest), 1, 4)) if partial else F.concat(F.lit("ANON_"), F.substring(F.md5(value), 1, 8))
    if strategy == "encrypt":
        return F.lit("[ENCRYPTED_PARTIAL]" if partial else "[ENCRYPTED_FULL]")
    return (F.when(value.contains("@"), F.concat(F.repeat(F.lit("*"), F.length(F.substring_index(value, "@", 1))), F.lit("@"),
                                                F.substring_index(value, "@", -1)))
            .when(value.rlike(r"^[\d\s()+\-]{7,}$"), F.concat(F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(0))), F.right(value, F.lit(4))))
            .otherwise(F.repeat(F.lit("*"), n)))


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 as two nested hashes over the padded constant key."""
    k = key.encode()
    k = hashlib.sha256(k).digest() if len(k) > 64 else k
    k = k.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def blake2b(value: Column, key: str = "") -> Column:
    @F.pandas_udf(T.StringType())
    def run(v: pd.Series) -> pd.Series:
        k = key.encode()[:64]
        return v.map(lambda s: s if s is None else hashlib.blake2b(s.encode(), key=k).hexdigest())
    return run(value)


def keyed_hash(value: Column, salt: str, algorithm: str = "sha256") -> Column:
    if algorithm == "sha256":
        return hmac_sha256(value, salt)
    if algorithm == "blake2b":
        return blake2b(value, salt)
    raise ValueError(f"unsupported algorithm {algorithm!r}")


def hash_with(value: Column, algorithm: str = "sha256", salt: Column | None = None, iterations: int = 1) -> Column:
    """Hex digest of salt and value, hashed again ``iterations - 1`` times; the salt is a stored column, so that it can be verified. Null stays null."""
    kinds = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "blake2b": blake2b}
    if algorithm not in kinds:
        raise ValueError(f"unsupported algorithm {algorithm!r}")
    if iterations < 1:
        raise ValueError("iterations must be at least 1")
    out = value if salt is None else F.concat(salt, value)
    for _ in range(iterations):
        out = kinds[algorithm](out)
    return out


def verify_hash(value: Column, expected: Column, algorithm: str = "sha256", salt: Column | None = None, iterations: int = 1) -> Column:
    """Whether the value has this digest under its stored salt; false where either is null."""
    return F.coalesce(hash_with(value, algorithm, salt, iterations) == expected, F.lit(False))
