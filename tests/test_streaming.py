import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from faultline.operators import detectors as D
from faultline.sources.tables import telemetry
from faultline.streaming import jobs as J


def test_history_detectors_over_several_batches(spark, sf_dir, tmp_path):
    """The state table carries the history: many micro-batches give the batch result."""
    t = telemetry(spark, sf_dir)
    for i, (lo, hi) in enumerate([(0, 300), (300, 301), (301, 700), (700, 10_000)]):
        t.where(F.col("event_id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    names = ["statistical_outlier", "error_clustering", "duration_outlier"]
    s = J.stream_files(spark, str(tmp_path / "in"), t.schema, files_per_trigger=1)
    J.detect_with_history(s, names, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), limit=30).awaitTermination()
    pick = lambda df: {r.event_id: r for r in df.select("event_id", *[F.struct(F.col(f"{n}.detected"), F.round(f"{n}.confidence", 6)).alias(n) for n in names]).collect()}
    got, want = pick(spark.read.parquet(str(tmp_path / "out"))), pick(D.detect(t, names, limit=30))
    assert got == want


def test_state_rewrites_touched_buckets_only(spark, tmp_path):
    state = J.KeyedState(spark, str(tmp_path / "state"), "k", 8)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long")
    held = {}
    for number, names in enumerate([list("abcdefghij"), ["a"], ["b", "c"], ["a"], ["a"]]):
        new = frame([(k, number) for k in names])
        touched = state.touched(new)
        old = state.read(number - 1, touched, new.schema)
        assert {tuple(r) for r in (old.collect() if old is not None else [])} == {(k, v) for k, v in held.items() if state.touched(frame([(k, 0)]))[0] in touched}
        held |= {k: number for k in names}
        rows = [(k, v) for k, v in held.items() if state.touched(frame([(k, 0)]))[0] in touched]
        for _ in range(2):  # a batch that is repeated changes nothing
            state.write(number, touched, frame(rows))
        written = {p.name for p in (tmp_path / "state" / f"batch={number}").glob("state_bucket=*")}
        assert written == {f"state_bucket={b}" for b in touched} and (number == 0 or len(written) < 8)
        everything = state.read(number, range(8), new.schema)
        assert {tuple(r) for r in everything.collect()} == set(held.items())
    left = {int(p.parent.name.split("=")[1]) for p in (tmp_path / "state").glob("batch=*/state_bucket=*") if p.name == f"state_bucket={state.touched(frame([('a', 0)]))[0]}"}
    assert left == {3, 4} and {p.name for p in (tmp_path / "state" / "manifest").glob("batch=*")} == {"batch=3", "batch=4"}


def test_trust_state_survives_batches(spark, tmp_path):
    rows = [("f", i, i, 0.05 if i % 3 else -0.05) for i in range(40)]
    df = spark.createDataFrame(rows, "function_id string, ts_us long, event_id long, trust_delta double")
    for lo in (0, 10, 25):
        df.where(F.col("event_id").between(lo, {0: 9, 10: 24, 25: 99}[lo])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = J.stream_files(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    J.run(J.trust_stream(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.event_id: r.trust for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    x = 0.8
    for _, _, i, d in rows:
        x = min(1.0, max(0.1, x + d))
        assert abs(got[i] - x) < 1e-9


def test_late_rows_are_dropped(spark, tmp_path):
    sch = "function_id string, ts timestamp, anomaly_type string"
    for i, at in enumerate(["2024-01-01 00:00:10", "2024-01-01 00:05:00", "2024-01-01 00:06:00", "2024-01-01 00:00:11"]):
        spark.createDataFrame([("f", at, "benign")], "function_id string, ts string, anomaly_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = J.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], sch).schema, files_per_trigger=1)
    J.run(J.tumbling(s, "function_id"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).where("w.start = timestamp'2024-01-01 00:00:00'").collect()
    assert len(first) == 1 and first[0].n == 1


def replay(rows, until):
    """The fallback rules of one key, second by second over plain lists of (time, kind, is_error, performance, channel, qos)."""
    mode, trigger, cooldown, since, checked, out = "NORMAL", None, -1, -(10**9), {}, []
    for t in range(min(int(r[0]) for r in rows) + 1, until + 1):
        seen = [r for r in rows if int(r[0]) + 1 <= t]
        age = lambda kinds: t - max((int(r[0]) + 1 for r in seen if r[1] in kinds), default=10**9)
        qos = {}
        for second in sorted({int(r[0]) for r in seen}):
            for c in {r[4] for r in seen if int(r[0]) == second and r[4]}:
                qos[c] = min(r[5] for r in seen if int(r[0]) == second and r[4] == c)
        if t < cooldown:
            continue
        points = [r[3] for r in seen if t - int(r[0]) - 1 < 60 and r[3] is not None]
        near = [r[2] for r in seen if t - int(r[0]) - 1 < 30]
        found, target = None, "DEGRADED"
        if age(("telemetry", "trace", "side")) > 5:
            found = "no_telemetry"
        elif age(("trace",)) > 3 or age(("side",)) > 3:
            found = "data_missing"
        elif len(points) >= 10 and sum(points) / len(points) < 0.5:
            found = "performance"
        elif sum(near) >= 3 and sum(near) / len(near) > 0.2:
            found = "error_rate"
        else:
            low = [c for c, q in qos.items() if q < 0.3 and abs(q - checked.get(c, 1.0)) > 0.1]
            checked = qos
            if low:
                if any(q >= 0.4 for c, q in qos.items() if c not in low):
                    continue
                found, target = "channel_degradation", "EMERGENCY"
        before = (mode, trigger)
        if found:
            mode, trigger, cooldown, since = target, found, t + 30, t
        elif mode != "NORMAL" and t >= since + 10:
            mode, trigger = "NORMAL", None
        if (mode, trigger) != before:
            out.append((t, before[0], mode, trigger or "recovered"))
    return out


def records(seed, seconds):
    """Quiet and busy stretches, bad ones and silence, two channels that fail together or alone."""
    r, rows, t = random.Random(seed), [], 0.0
    while t < seconds:
        kind = r.choice(("busy", "errors", "slow", "channel", "both", "no_trace", "silence"))
        end = t + r.randint(8, 70)
        while t < end:
            if kind == "silence":
                t = end
                break
            what = r.choice(("telemetry", "side") if kind == "no_trace" else ("telemetry", "trace", "side"))
            channel = r.choice(("c1", "c2", None))
            low = kind == "both" or (kind == "channel" and channel == "c1")
            rows.append((t, what, kind == "errors" and r.random() < 0.5, r.choice((None, 0.2 if kind == "slow" else 0.9)), channel, (0.1 if low else 0.8) if channel else None))
            t += r.uniform(0.1, 0.9)
    return rows


def test_fallback_rules_second_by_second():
    reasons = set()
    for seed in range(6):
        rows = records(seed, 300)
        rules, out = J.Fallback(), []
        for s in sorted({int(r[0]) for r in rows}):
            here = [r for r in rows if int(r[0]) == s]
            points = [r[3] for r in here if r[3] is not None]
            qos = {c: min(r[5] for r in here if r[4] == c) for c in {r[4] for r in here if r[4]}}
            row = SimpleNamespace(n=len(here), traces=sum(r[1] == "trace" for r in here), sides=sum(r[1] == "side" for r in here), errors=sum(r[2] for r in here), points=len(points), performance=sum(points), qos=qos)
            out += rules.read(s, row)
            rules = J.Fallback(rules.keep())  # as read back from the state
        out += rules.wait(501)
        assert out == replay(rows, 500)
        reasons |= {(m, why) for _, _, m, why in out}
    assert {("EMERGENCY", "channel_degradation"), ("DEGRADED", "no_telemetry"), ("DEGRADED", "data_missing"), ("DEGRADED", "performance"), ("DEGRADED", "error_rate"), ("NORMAL", "recovered")} <= reasons


def test_fallback_stream_in_batches_and_by_timers(spark, tmp_path):
    """Many micro-batches equal the replay; a key that falls silent changes by its timer while only another key has records."""
    rows = [("busy", *r) for r in records(11, 300)] + [("quiet", float(t), "telemetry", False, None, None, None) for t in range(5, 20)] + [("busy", 400.0, "trace", False, None, None, None)]
    df = spark.createDataFrame(rows, "k string, t double, kind string, is_error boolean, performance double, channel string, qos double").withColumn("ts", F.timestamp_seconds("t"))
    for lo, hi in ((0, 15), (15, 16), (16, 140), (140, 300), (300, 999)):
        df.where(f"t >= {lo} AND t < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = J.stream_files(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    J.run(J.fallback_stream(s, "k"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {k: sorted((r.second, r.previous, r.mode, r.reason) for r in out if r.k == k) for k in ("busy", "quiet")}
    assert got["quiet"] == replay([r[1:] for r in rows if r[0] == "quiet"], 395) == [(26, "NORMAL", "DEGRADED", "no_telemetry")]
    assert got["busy"] == replay([r[1:] for r in rows if r[0] == "busy" and r[1] < 395], 395)
