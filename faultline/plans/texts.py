"""Queries of sanitising, personal data and hashing over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import text as TX
from faultline.operators import preservation, validation
from faultline.plans.common import TEL, Query, r
from faultline.sources.tables import spread, table, telemetry

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SAFE = r"""replace(replace(replace(replace(replace(regexp_replace(c, '(?is)<script[^>]*>.*?</script>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_SANI = f"""u AS (SELECT id, v AS t, regexp_replace(regexp_replace(v, '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{feff}}\\x{{2060}}-\\x{{2064}}]', '', 'g'), '', '', '') AS a FROM src),
b AS (SELECT *, regexp_replace(a, '[;&|$`]', '', 'g') AS c FROM u),
d AS (SELECT *, CASE WHEN regexp_matches(c, '[<>"]') THEN {_SAFE} ELSE c END AS e FROM b),
s AS (SELECT id, md5(e) AS digest, array_to_string(list_filter([CASE WHEN a <> t THEN 'unicode' END, CASE WHEN c <> a THEN 'command' END,
  CASE WHEN e <> c THEN 'html' END, CASE WHEN regexp_matches(e, {_lit(TX.SQL_WORDS)}) THEN 'sql' END], lambda x: x IS NOT NULL), ',') AS flags FROM d)
"""


def short_batches(spark) -> None:
    """At most 256 whole texts in one Arrow batch: a Python worker holds a batch several times over, whatever the table's size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key, "10000"))
    spark.conf.set(key, str(min(rows, 256) if rows > 0 else 256))


@query("WITH src AS (SELECT page_id AS id, html AS v FROM pages), " + _SANI + "SELECT id AS page_id, digest, flags FROM s")
def sanitise_pages(spark, sf_dir):
    short_batches(spark)
    out = TX.sanitise(spread(table(spark, sf_dir, "pages")), "html")
    return out.select("page_id", F.md5("sanitised").alias("digest"), F.concat_ws(",", "flags").alias("flags"))


@query("WITH src AS (SELECT doc_id AS id, text AS v FROM documents), " + _SANI + "SELECT id AS doc_id, digest, flags FROM s")
def sanitise_documents(spark, sf_dir):
    short_batches(spark)
    out = TX.sanitise(spread(table(spark, sf_dir, "documents")), "text")
    return out.select("doc_id", F.md5("sanitised").alias("digest"), F.concat_ws(",", "flags").alias("flags"))


@query(r"""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) IN ('http','https') THEN
  regexp_extract(url, '^([^:]+)://', 1) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) || regexp_extract(url, '^[^:/?#]+://[^/?#]*(.*)$', 1) ELSE '' END AS clean_url FROM pages""")
def sanitise_url(spark, sf_dir):
    withuser = F.regexp_replace("url", "^(https?://)", "$1user:pw@")
    return spread(table(spark, sf_dir, "pages")).select("page_id", TX.sanitise_url(withuser).alias("clean_url"))


@query(r"""SELECT page_id, trim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') || '/end' AS clean_path FROM pages""")
def sanitise_path(spark, sf_dir):
    raw = F.concat(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit(r"/./tmp\..\//end"))
    return spread(table(spark, sf_dir, "pages")).select("page_id", TX.sanitise_path(raw).alias("clean_path"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(text || chr(7), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), ' ')) AS digest FROM conversations""")
def strip_control_chars(spark, sf_dir):
    t = spread(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "turn", F.md5(TX.strip_control(F.concat("text", F.lit("\x07")))).alias("digest"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, {_lit(TX.EMAIL)}, '[REDACTED_EMAIL]', 'g'), {_lit(TX.LOOSE_PHONE)}, '[REDACTED_PHONE]', 'g'),
  {_lit(TX.LOOSE_CARD)}, '[REDACTED_CARD]', 'g')) AS digest FROM documents""")
def redact_intake(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(TX.redact_intake(F.col("text"))).alias("digest"))


_SSN = (r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d\d|6[0-57-9]\d|66[0-57-9])-(?:0[1-9]|[1-9]\d)-(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b")


def _regime_sql(regime: str) -> str:
    ctes, prev = ["v0 AS (SELECT doc_id, text AS v FROM documents)"], "v0"
    for i, name in enumerate(TX.REGIMES[regime], 1):
        pattern = _SSN if name == "ssn" else TX.PATTERNS[name]
        tag = f"[REDACTED_{name.upper()}]"
        if name == "credit_card":
            digits = "list_reverse(string_split(regexp_replace(m, '\\D', '', 'g'), ''))"
            luhn = f"""len({digits}) >= 13 AND list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 0
              THEN CAST(d AS INT) * 2 - CASE WHEN CAST(d AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(d AS INT) END)) % 10 = 0"""
            ctes.append(f"m{i} AS (SELECT *, list_filter(regexp_extract_all(v, {_lit(pattern)}), lambda m: {luhn}) AS ms FROM {prev})")
            prior = ", ".join(f"n{j}" for j in range(1, i))
            ctes.append(f"""v{i} AS (SELECT doc_id, {prior}, len(ms) AS n{i},
              list_reduce(list_prepend(v, ms), lambda t, raw: replace(t, raw, '{tag}')) AS v FROM m{i})""")
        else:
            prior = ", ".join([""] + [f"n{j}" for j in range(1, i)])[0:] if i > 1 else ""
            prior = "".join(f", n{j}" for j in range(1, i))
            ctes.append(f"v{i} AS (SELECT doc_id{prior}, len(regexp_extract_all(v, {_lit(pattern)})) AS n{i}, regexp_replace(v, {_lit(pattern)}, '{tag}', 'g') AS v FROM {prev})")
        prev = f"v{i}"
    return "WITH " + ", ".join(ctes)


def _regime_query(regime: str) -> None:
    names = TX.REGIMES[regime]

    def run(spark, sf_dir):
        out = TX.privacy_filter(spread(table(spark, sf_dir, "documents")), "text", regime)
        return out.select("doc_id", F.md5("filtered").alias("digest"), *[F.coalesce(F.col("actions")[n], F.lit(0)).cast("bigint").alias(n) for n in names])

    QUERIES[f"privacy_filter_{regime}"] = run
    cols = ", ".join(f"n{i} AS {n}" for i, n in enumerate(names, 1))
    ORACLES[f"privacy_filter_{regime}"] = _regime_sql(regime) + f" SELECT doc_id, md5(v) AS digest, {cols} FROM v{len(names)}"


_regime_query("gdpr")
_regime_query("hipaa")

_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, '{k}' AS pii_type, unnest(regexp_extract_all(text, {_lit(p)})) AS value FROM documents" for n, (k, p, _) in TX.RULES.items())


@query(f"SELECT doc_id, rule, count(*) AS n, md5(string_agg(value, '|' ORDER BY value)) AS digest FROM ({_SPANS}) GROUP BY doc_id, rule")
def detect_pii(spark, sf_dir):
    spans = spread(table(spark, sf_dir, "documents")).select("doc_id", F.inline(TX.detect_spans(F.col("text"))))
    return spans.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("value")), "|")).alias("digest"))


@query(f"SELECT pii_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_SPANS}) GROUP BY pii_type")
def privacy_report(spark, sf_dir):
    spans = spread(table(spark, sf_dir, "documents")).select("doc_id", F.inline(TX.detect_spans(F.col("text"))))
    return spans.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(None)
def redact_pii(spark, sf_dir):
    t = spread(table(spark, sf_dir, "documents")).withColumn("spans", TX.detect_spans(F.col("text")))
    return t.select("doc_id", F.size("spans").alias("n"), F.md5(TX.redact_spans(F.col("text"), F.col("spans"))).alias("masked"),
                    F.md5(TX.redact_spans(F.col("text"), F.col("spans"), "hash")).alias("hashed"))


@query("""SELECT c_custkey, repeat('*', length(c_name)) AS masked, substr(sha256(c_name), 1, 16) AS hashed, substr(c_name, 1, 2) || substr(md5(substr(c_name, 3)), 1, 8) AS hashed_part,
  repeat('*', length('user' || c_custkey)) || '@example.com' AS mail, 'ANON_' || substr(md5(c_name), 1, 8) AS anonymous, '[ENCRYPTED_FULL]' AS encrypted FROM customer""")
def redact_by_policy(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    name = F.col("c_name")
    return t.select("c_custkey", TX.mask_value(name).alias("masked"), TX.mask_value(name, "hash").alias("hashed"), TX.mask_value(name, "hash", True).alias("hashed_part"),
                    TX.mask_value(mail).alias("mail"), TX.mask_value(name, "anonymize").alias("anonymous"), TX.mask_value(name, "encrypt").alias("encrypted"))


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in b"salt".ljust(64, b"\0"))


@query(f"""SELECT doc_id, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(text)))) AS digest FROM documents""")
def hash_fields(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", TX.keyed_hash(F.col("text"), "salt").alias("digest"))


@query("""SELECT doc_id, sha256(sha256(md5(doc_id::VARCHAR) || text)) AS digest, text IS NOT NULL AS verified, text IS NOT NULL AND doc_id % 10 > 0 AS verified_changed FROM documents""")
def salted_hash(spark, sf_dir):
    """Texts hashed twice under a stored salt and verified, once as they are and once with every tenth text changed."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("salt"))
    d = d.withColumn("digest", TX.hash_with(F.col("text"), salt=F.col("salt"), iterations=2))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    check = lambda v: TX.verify_hash(v, F.col("digest"), salt=F.col("salt"), iterations=2)
    return d.select("doc_id", "digest", check(F.col("text")).alias("verified"), check(changed).alias("verified_changed"))


@query(None)
def hash_blake2b(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", TX.keyed_hash(F.col("text"), "salt", "blake2b").alias("digest"))


_CONTENT = """sha256('{"anomaly_type":"' || anomaly_type || '","event_id":' || event_id || ',"function_id":"' || function_id || '","memory_spike_kb":' || memory_spike_kb
  || ',"network_io_bytes":' || network_io_bytes || '}')"""


@query(f"""WITH {TEL}, c AS (SELECT event_id, {_CONTENT} AS h FROM tel) SELECT event_id, h AS content_hash,
  sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(h)))) AS signature, event_id % 10 <> 0 AS verified FROM c""")
def sign_and_verify(spark, sf_dir):
    """Content hash over canonical JSON (sorted keys), HMAC signature, and a check after tampering."""
    def content(df):
        return F.sha2(F.to_json(F.struct("anomaly_type", "event_id", "function_id", "memory_spike_kb", "network_io_bytes")), 256)
    t = telemetry(spark, sf_dir)
    t = t.withColumn("content_hash", content(t))
    t = t.withColumn("signature", TX.hmac_sha256(F.col("content_hash"), "salt"))
    t = t.withColumn("memory_spike_kb", F.when(F.col("event_id") % 10 == 0, F.col("memory_spike_kb") + 1).otherwise(F.col("memory_spike_kb")))
    ok = (content(t) == F.col("content_hash")) & (TX.hmac_sha256(content(t), "salt") == F.col("signature"))
    return t.select("event_id", "content_hash", "signature", ok.alias("verified"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS payload_hash,
  substr(md5('user_id:' || printf('%.2f', user_id::DOUBLE) || '|value:' || printf('%.2f', floor(value))), 1, 16) AS signature FROM events""")
def payload_hash(spark, sf_dir):
    """Hash of the payload without volatile keys; behavioural signature of numeric fields."""
    t = table(spark, sf_dir, "events").drop("ts", "props")
    fields = [F.concat(F.lit("user_id:"), F.format_string("%.2f", F.col("user_id").cast("double"))),
              F.concat(F.lit("value:"), F.format_string("%.2f", F.floor("value").cast("double")))]
    return t.select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("payload_hash"),
                    F.substring(F.md5(F.array_join(F.array_sort(F.array(*fields)), "|")), 1, 16).alias("signature"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), k AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM k GROUP BY doc_id""")
def text_entropy(spark, sf_dir):
    return preservation.char_entropy(spread(table(spark, sf_dir, "documents")), "doc_id", "text").select("doc_id", r("entropy").alias("entropy"))


_UNSAFE = ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{n}' END" for n, p in validation.SUSPICIOUS.items())


@query(f"""WITH i AS (SELECT page_id, list_filter([{_UNSAFE}], lambda x: x IS NOT NULL) AS found, length(html) > 10000 AS long FROM pages)
SELECT page_id, array_to_string(CASE WHEN long THEN list_append(found, 'too_long') ELSE found END, ',') AS issues, CASE WHEN len(found) > 0 THEN 'critical' WHEN long THEN 'warning' ELSE 'none' END AS severity FROM i""")
def payload_safety(spark, sf_dir):
    return validation.payload_safety(spread(table(spark, sf_dir, "pages")), "html").select("page_id", F.concat_ws(",", "issues").alias("issues"), "severity")


@query("""WITH p AS (SELECT event_id AS id, CASE WHEN event_id % 101 = 0 THEN '{broken' ELSE '{"deep":' || repeat('{"d":', (event_id % 14)::INT) || '1' || repeat('}', (event_id % 14)::INT) || ',"list":[' || array_to_string(range(0, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1), ',')
  || '],"keys":{' || array_to_string(list_transform(range(0, event_id % 9 + 1), lambda i: '"a' || i || '":1'), ',') || '},"note":"' || repeat('x', (event_id % 17)::INT) || '"}' END AS raw FROM events),
t AS (SELECT p.id, j.fullkey, j.path, j.type, j.atom, len(regexp_replace(j.fullkey, '[^.\\[]', '', 'g')) AS depth FROM (SELECT * FROM p WHERE raw <> '{broken') p, json_tree(p.raw) j)
SELECT id, 'root' AS path, 'invalid_json' AS issue, 0::BIGINT AS size FROM p WHERE raw = '{broken'
UNION ALL SELECT id, 'root' || fullkey[2:], 'too_deep', 11 FROM t WHERE depth = 11
UNION ALL SELECT id, 'root' || fullkey[2:], 'string_too_long', len(json_extract_string(atom, '$')) FROM t WHERE type = 'VARCHAR' AND depth <= 10 AND len(json_extract_string(atom, '$')) > 12
UNION ALL SELECT c.id, 'root' || c.path[2:], CASE WHEN any_value(o.type) = 'OBJECT' THEN 'too_many_keys' ELSE 'list_too_long' END, count(*) FROM t c JOIN t o ON o.id = c.id AND o.fullkey = c.path AND c.fullkey <> '$' WHERE c.depth <= 11 GROUP BY c.id, c.path
  HAVING count(*) > CASE WHEN any_value(o.type) = 'OBJECT' THEN 5 ELSE 90 END""")
def payload_structure(spark, sf_dir):
    raw = F.expr("""CASE WHEN event_id % 101 = 0 THEN '{broken' ELSE concat('{"deep":', repeat('{"d":', int(event_id % 14)), '1', repeat('}', int(event_id % 14)), ',"list":[',
        array_join(sequence(0, int(get_json_object(props, '$.k'))), ','), '],"keys":{', array_join(transform(sequence(0, int(event_id % 9)), i -> concat('"a', i, '":1')), ','), '},"note":"', repeat('x', int(event_id % 17)), '"}') END""")
    return validation.payload_structure(spread(table(spark, sf_dir, "events")).withColumn("raw", raw), "event_id", "raw", 10, 5, 90, 12)
