"""The walk through JSON payloads keeps only what can still break a limit."""

import json

from faultline import session
from faultline.operators import validation


def test_only_what_can_break_a_limit_goes_on(spark, monkeypatch):
    stored, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: [kept := cut(df), stored.append(kept.count())][0])
    rows = [(i, json.dumps({"list": list(range(50)), "note": "x" * i, "deep": {"a": {"b": [1]}}})) for i in range(20)] + [(20, "{no"), (21, None), (22, '"' + "y" * 30 + '"')]
    got = validation.payload_structure(spark.createDataFrame(rows, "id long, raw string"), "id", "raw", 2, 3, 49, 15)
    want = {(i, "root.list", "list_too_long", 50) for i in range(20)} | {(i, "root.note", "string_too_long", i) for i in range(16, 20)}
    want |= {(i, "root.deep.a.b", "too_deep", 3) for i in range(20)} | {(20, "root", "invalid_json", 0), (22, "root", "string_too_long", 30)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(stored) <= 150  # 20 lists of 50 numbers are none of it


def test_an_empty_object_holds_nothing(spark):
    rows = [(1, '{"a":{}}'), (2, '{"a":[]}'), (3, '{"a":{"b":1}}')]
    got = validation.payload_structure(spark.createDataFrame(rows, "id long, raw string"), "id", "raw", max_depth=1)
    assert [tuple(r) for r in got.collect()] == [(3, "root.a.b", "too_deep", 2)]
