import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from faultline.functions import text as TX


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first().x


def test_sanitise_chain(spark):
    df = spark.createDataFrame([(1, "ｆｕｌｌ​"), (2, "a;b|c`$"), (3, "<script>x</script><b>\"hi\"</b>"), (4, "drop table x"), (5, None), (6, "plain")], "id int, t string")
    rows = {r.id: r for r in TX.sanitise(df, "t").collect()}
    assert rows[1].sanitised == "full" and rows[1].flags == ["unicode"]
    assert rows[2].sanitised == "abc" and rows[2].flags == ["command"]
    assert rows[3].sanitised == "&lt;b&gt;&quot;hi&quot;&lt;/b&gt;" and rows[3].flags == ["html"]
    assert rows[4].flags == ["sql"]
    assert rows[5].sanitised is None and rows[6].flags == []


def test_url_and_path(spark):
    url = lambda u: one(spark, TX.sanitise_url(F.col("u")), u=u)
    assert url("https://user:pw@Example.com:8080/a?b=1#c") == "https://example.com:8080/a?b=1#c"
    assert url("javascript:alert(1)") == "" and url("ftp://x/y") == ""
    path = lambda p: one(spark, TX.sanitise_path(F.col("p")), p=p)
    assert path("../../etc/passwd") == "etc/passwd" and path("/a/./b/../c") == "a/c" and path("a\\b") == "a/b" and path("..") == "."


def test_luhn_and_regime(spark):
    df = spark.createDataFrame([("card 4111 1111 1111 1111 end",), ("card 4111 1111 1111 1112 end",), ("mail a.b@c.org ip 10.0.0.1",), ("ssn 123-45-6789 and 000-12-3456",)], ["t"])
    out = [r.filtered for r in TX.privacy_filter(df, "t", "gdpr").collect()]
    assert out[0] == "card [REDACTED_CREDIT_CARD] end"
    assert "1112" in out[1]
    assert out[2] == "mail [REDACTED_EMAIL] ip [REDACTED_IPV4]"
    assert out[3].startswith("ssn [REDACTED_SSN] and 000-12")
    crit = TX.privacy_filter(df, "t", "gdpr", critical=True).first().filtered
    assert "[PSEUDO:" + hashlib.sha256(b"4111 1111 1111 1111").hexdigest()[:16] + "]" in crit


def test_spans_and_policies(spark):
    t = "x a@b.co y 192.168.0.1 z"
    df = spark.createDataFrame([(t,)], ["t"]).withColumn("s", TX.detect_spans(F.col("t")))
    row = df.select("s", *[TX.redact_spans(F.col("t"), F.col("s"), p).alias(p) for p in ("mask", "remove", "partial_mask")]).first()
    for s in row.s:
        assert t[s.start: s.start + len(s.value)] == s.value
    assert row["mask"] == "x ****** y *********** z"
    assert row["remove"] == "x [REMOVED] y [REMOVED] z"
    assert row["partial_mask"] == "x a@**co y 19*******.1 z"


def test_keyed_hashes(spark):
    for key in ("salt", "k" * 100):
        assert one(spark, TX.hmac_sha256(F.col("v"), key), v="héllo") == hmac.new(key.encode(), "héllo".encode(), "sha256").hexdigest()
    assert one(spark, TX.keyed_hash(F.col("v"), "salt", "blake2b"), v="x") == hashlib.blake2b(b"x", key=b"salt").hexdigest()


def test_overlapping_spans_are_covered_once(spark):
    t = "call 555-12-3456-7890 now, a@b.example"
    span = lambda start, value: (start, "k", "r", value, 0.9)
    spans = [span(5, "555-12-3456"), span(9, "12-3456-7890"), span(27, "a@b.example"), span(27, "a@b")]
    df = spark.createDataFrame([(t, spans)], "t string, s array<struct<start:int,pii_type:string,rule:string,value:string,confidence:double>>")
    row = df.select(*[TX.redact_spans(F.col("t"), F.col("s"), p).alias(p) for p in ("mask", "remove", "hash")]).first()
    assert row.mask == "call " + "*" * 16 + " now, " + "*" * 11
    assert row.remove == "call [REMOVED] now, [REMOVED]"
    assert row.hash.startswith("call [HASH:") and row.hash.count("[HASH:") == 2 and " now, " in row.hash


def test_payload_structure_against_recursion(spark):
    import json
    import random

    from faultline.operators import validation

    r = random.Random(1)

    def tree(depth):
        kind = r.random()
        if depth == 0 or kind < 0.2:
            return r.choice((1, 2.5, None, True, "x" * r.randint(0, 14), ""))
        if kind < 0.6:
            return {f"k{i}": tree(depth - 1) for i in range(r.randint(0, 5))}
        return [tree(depth - 1) for _ in range(r.randint(0, 5))]

    def walk(v, path, depth, found):
        if depth > 3:
            found.append((path, "too_deep", depth))
        elif isinstance(v, str) and len(v) > 10:
            found.append((path, "string_too_long", len(v)))
        elif isinstance(v, (dict, list)):
            if len(v) > 3:
                found.append((path, "too_many_keys" if isinstance(v, dict) else "list_too_long", len(v)))
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                walk(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]", depth + 1, found)
        return found

    trees = [tree(6) for _ in range(60)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(trees)] + [(100, None), (101, "{broken"), (102, "[NaN]")]
    got = validation.payload_structure(spark.createDataFrame(rows, "id long, raw string"), "id", "raw", 3, 3, 3, 10).collect()
    want = [(i, *x) for i, v in enumerate(trees) for x in walk(v, "root", 0, [])] + [(101, "root", "invalid_json", 0), (102, "root", "invalid_json", 0)]
    assert sorted(tuple(x) for x in got) == sorted(want) and len({x[2] for x in want}) == 5


def test_salted_hashes(spark):
    rows = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("", "s"), (None, "s"), ("ä" * 5000, None)], "v string, salt string")
    for name in ("sha256", "sha512", "blake2b"):
        plain = lambda b: getattr(hashlib, name)(b.encode()).hexdigest()  # noqa: B023, E731
        out = rows.withColumns({"h": TX.hash_with(F.col("v"), name, F.col("salt"), 2), "u": TX.hash_with(F.col("v"), name)})
        out = out.withColumns({"ok": TX.verify_hash(F.col("v"), F.col("h"), name, F.col("salt"), 2), "other": TX.verify_hash(F.concat("v", F.lit(".")), F.col("h"), name, F.col("salt"), 2)})
        for r in out.collect():
            whole = r.v is not None and r.salt is not None
            assert r.h == (plain(plain(r.salt + r.v)) if whole else None) and r.u == (None if r.v is None else plain(r.v))
            assert (r.ok, r.other) == (whole, False)
    with pytest.raises(ValueError):
        TX.hash_with(F.col("v"), "md5")
    with pytest.raises(ValueError):
        TX.hash_with(F.col("v"), iterations=0)


@pytest.mark.parametrize("name", ["sanitise_pages", "sanitise_documents"])
def test_python_gets_few_whole_texts_at_a_time(spark, sf_dir, name):
    from faultline.plans.texts import QUERIES

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get(key)) <= 256
    finally:
        spark.conf.set(key, before)
