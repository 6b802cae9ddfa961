import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from faultline.operators import graphs as G, semantics as S

FIELDS = "event_id long, trace string, function_id string, event string, error_message string"
EVENTS = [
    ("api-user-handler", '{"httpMethod":"GET","path":"/x\\"y","headers":{"a":"1","b":"2"},"body":"{\\"k\\": 69, \\"a\\": [1,{\\"z\\":2}], \\"t\\":true}"}', "Timeout!"),
    ("fn", "{}", None), ("Fn-Api", '{"a":{"b":{"c":{}}},"l":[{"q":{"r":1}}],"body":{"k":1.5,"s":"a,b:c{"}}', "auth problem"),
    ("x", None, ""), ("x", "[1]", "weird"), ("x", '{"body":"not json"}', "low memory"), ("x", '{"body":"\\"abc\\""}', None), ("x", '{"body":{}}', None),
    ("x", '{"body":"null"}', "x"), ("x", '{"body":"[1, 2]"}', "net connection"), ("x", "bad{", None), ("", '{"body":"{}","headers":{}}', "network"), ("x", '{"body":7}', None),
    ("a-" * 500, json.dumps({"body": "{" + ", ".join(f'"k{i}": {i}' for i in range(2000)) + "}", "path": "/" + "p" * 5000}), "Permission"),
    (None, '{"e":[],"f":{"g":true,"h":[{"i":{}}]},"body":"false"}', None),
]


def plain(function, event, error):
    """The same by dictionaries, one event at a time."""
    try:
        event = json.loads(event)
    except (TypeError, ValueError):
        event = None
    held = isinstance(event, dict)

    def deep(d, at=0):
        return max((deep(v, at + 1) if isinstance(v, dict) else at + 1 for v in d.values()), default=at)

    name, low = (function or "").lower(), (error or "").lower()
    kind = next((v for w, v in (("timeout", 1), ("memory", 2), ("permission", 3), ("auth", 3), ("network", 4), ("connection", 4)) if w in low), 0.5) if error else 0
    inner = (deep(event), len(event), any(isinstance(v, dict) for v in event.values())) if held else (None,) * 3
    features = (*((len(name.split("-")), "handler" in name, "api" in name) if function is not None else (None, 0, 0)), *inner, bool(error), kind)
    event = event if held else {}
    call = {"method": event.get("httpMethod", ""), "path": event.get("path", ""), "headers_count": len(event.get("headers", {})), "body_present": bool(event.get("body"))}
    digest = lambda o: hashlib.md5(json.dumps(o, sort_keys=True).encode()).hexdigest()[:8]
    body, signature = event.get("body"), "no_payload"
    if body:
        try:
            body = json.loads(body) if isinstance(body, str) else body
            signature = digest({"keys": sorted(body) if isinstance(body, dict) else [], "type": type(body).__name__, "size": len(str(body))})
        except ValueError:
            signature = "invalid_json"
    return features, digest(call), signature


@pytest.fixture(scope="module")
def described(spark):
    rows = [(i, "t", *e) for i, e in enumerate(EVENTS)]
    return S.describe(spark.createDataFrame(rows, FIELDS)).withColumn("vector", S.embedding())


def test_features_and_signatures(described):
    got = {r["event_id"]: r for r in described.collect()}
    assert len(got) == len(EVENTS)
    for i, e in enumerate(EVENTS):
        features, call, signature = plain(*e)
        assert (i, *got[i]["textual"]) == (i, *features)
        assert (i, got[i]["call_pattern"], got[i]["payload_signature"]) == (i, call, signature)
        there = [float(f) for f in features if f is not None]
        norm = math.sqrt(sum(f * f for f in there)) or 1.0
        assert got[i]["vector"] == pytest.approx([f / norm for f in there] + [0.0] * (32 - len(there)))


def test_pairs(spark, described):
    side = lambda p: described.select(*[described[c].alias(p + c) for c in ("event_id", "function_id", "textual", "payload_signature", "error_message", "vector")])
    pairs = side("a_").crossJoin(side("b_")).withColumn("s", S.similarity())
    for r in pairs.collect():
        x, y = tuple(r["a_textual"]), tuple(r["b_textual"])
        if None in (r["a_function_id"], r["b_function_id"]):
            continue
        like = [1 - abs(p - q) / max(1, p, q) for p, q in zip(x, y) if p is not None and q is not None]
        cos = sum(p * q for p, q in zip(r["a_vector"], r["b_vector"]))
        want = (0.25 * (r["a_function_id"] == r["b_function_id"]) + 0.35 * cos + 0.2 * sum(like) / len(like)
                + 0.1 * (r["a_payload_signature"] == r["b_payload_signature"]) + 0.1 * ((r["a_error_message"] or "") == (r["b_error_message"] or "")))
        assert r["s"] == pytest.approx(want), (r["a_event_id"], r["b_event_id"])


def test_edges_of_four_types(spark):
    base = "id AS event_id, 't' AS trace, 'api-handler' AS function_id, '{\"body\":{\"k\":1}}' AS event, CAST(NULL AS STRING) AS error_message, id * 1000000 AS ts_us, 'invoke' AS execution_phase"
    rows = spark.range(3).selectExpr(*base.split(", "), "'benign' AS anomaly_type", "1D AS duration", "10L AS memory_spike_kb", "5D AS cpu_utilization", "0L AS network_io_bytes")
    edges = G.correlation_edges(S.describe(rows), "trace").collect()
    assert {(e["src"], e["dst"], e["type"]) for e in edges} == {(a, b, t) for a, b in ((0, 1), (0, 2), (1, 2)) for t in ("temporal", "semantic", "behavioural", "causal")}
    one = next(e for e in edges if (e["src"], e["dst"]) == (1, 2))
    assert one["temporal"] == pytest.approx(0.4 * (1 - 1 / 600) + 0.25 + 0.2 + 0.15 / 2)
    assert one["semantic"] == pytest.approx(1.0) and one["behavioural"] == pytest.approx(1.0) and one["causal"] == pytest.approx(math.exp(-1 / 60))
    assert one["confidence"] == 1.0
    assert G.correlation_edges(S.describe(rows.where("false")), "trace").count() == 0


def test_totals_are_those_of_the_correlations(spark):
    from faultline.plans import graph
    rows = graph._described(spark, "/root/testdata/sf0.001").limit(300).localCheckpoint()
    edges = G.correlation_edges(rows, "trace", 3_600_000_000)
    score = F.expr("CASE type WHEN 'temporal' THEN temporal WHEN 'semantic' THEN semantic WHEN 'behavioural' THEN behavioural ELSE causal END")
    want = edges.groupBy("type").agg(F.count(F.lit(1)), F.round(F.avg("confidence"), 9), F.round(F.avg(score), 9))
    got = G.correlation_totals(rows, "trace", 3_600_000_000).select("type", "n", F.round("mean_confidence", 9), F.round("mean_score", 9))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() >= 3
