"""Structured Streaming jobs: windows, late data, deduplication, scoring, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline.operators import detectors as D, history as H

LATENESS = "5 seconds"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Stream of Parquet files; the bound per trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _marked(events: DataFrame, time: str, lateness: str) -> DataFrame:
    return events.withWatermark(time, lateness)


# Counts per window and key combine map-side, so a hot key costs one partial row per task and window.
def tumbling(events: DataFrame, key: str, time: str = "ts", size: str = "30 seconds", lateness: str = LATENESS) -> DataFrame:
    return window_result(events, [key], F.window(time, size), time, lateness)


def sliding(events: DataFrame, key: str, time: str = "ts", size: str = "60 seconds", slide: str = "30 seconds", lateness: str = LATENESS) -> DataFrame:
    """True overlap: a record counts in every window that covers it."""
    return window_result(events, [key], F.window(time, size, slide), time, lateness)


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    return window_result(events, [key], F.session_window(time, gap), time, lateness)


def global_totals(events: DataFrame, key: str) -> DataFrame:
    """Running totals per key, for update mode."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("anomaly_type") != "benign").alias("anomalies"), F.sum("duration").alias("total_duration"))


def window_result(events: DataFrame, keys: Sequence[str], window, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Count, first and last event time and anomalies per window."""
    w = window.alias("w")
    return _marked(events, time, lateness).groupBy(w, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("earliest"), F.max(time).alias("latest"), F.count_if(F.col("anomaly_type") != "benign").alias("anomalies"))


def dedup(events: DataFrame, keys: Sequence[str], time: str = "ts", within: str = "3600 seconds") -> DataFrame:
    """First record per id (or content hash) within the watermark."""
    return _marked(events, time, within).dropDuplicatesWithinWatermark(list(keys))


def dedup_batch(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest record per id or hash: an aggregate, not a sort, so copies combine map-side."""
    rest = F.struct(*order, *[c for c in events.columns if c not in order])
    return events.groupBy(*keys).agg(F.min(rest).alias("r")).select("r.*")


def run(result: DataFrame, out: str, checkpoint: str, mode: str = "append", once: bool = True, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a job into Parquet (append), or through ``write`` (any mode)."""
    w = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w
    return w.foreachBatch(write).start() if write else w.format("parquet").option("path", out).start()


def overwrite_latest(out: str) -> Callable[[DataFrame, int], None]:
    """Sink for complete and update mode results: each batch is written whole, under its number."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return write


#: buckets of keys that the history of a stream is stored in
BUCKETS = 64


class KeyedState:
    """Rows by bucket of keys in Parquet, versioned by batch: a batch rewrites only the buckets that its keys fall into.

    A manifest per batch says which version of each bucket counts after it; there are at most BUCKETS rows of it. A repeated batch reads the manifest
    of the batch before and rewrites its own files only. What neither this batch's nor the last one's manifest names is removed.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("state_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def touched(self, df: DataFrame) -> list[int]:
        return sorted(r[0] for r in self.bucketed(df).select("state_bucket").distinct().collect())

    def manifest(self, number: int) -> dict[int, int]:
        if number < 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/manifest/batch={number}").collect()}

    def read(self, number: int, buckets: Sequence[int], schema: T.StructType) -> DataFrame | None:
        """The rows of the buckets after batch ``number``; None if there are none yet."""
        at = self.manifest(number)
        paths = [f"{self.folder}/batch={at[b]}/state_bucket={b}" for b in buckets if b in at]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def write(self, number: int, buckets: Sequence[int], rows: DataFrame) -> None:
        """``rows`` as the new content of the buckets."""
        self.bucketed(rows).repartition("state_bucket").write.mode("overwrite").partitionBy("state_bucket").parquet(f"{self.folder}/batch={number}")
        last = self.manifest(number - 1)
        now = last | {b: number for b in buckets}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")
        if number > 1 and self._there(f"manifest/batch={number - 2}"):
            old = self.manifest(number - 2)
            for b, version in old.items():
                if version not in (last.get(b), now.get(b)):
                    self._remove(f"batch={version}/state_bucket={b}")
            self._remove(f"manifest/batch={number - 2}")

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        fs, path = self._files(name)
        return fs.exists(path)

    def _remove(self, name: str) -> None:
        fs, path = self._files(name)
        fs.delete(path, True)


def detect_with_history(events: DataFrame, names: Sequence[str], out: str, state: str, checkpoint: str, key: str = "function_id",
                        limit: int = H.HISTORY, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """History detectors on a stream.

    The last ``2 limit - 1`` records of every key (the farthest any detector looks back) are kept as `KeyedState`. Each micro-batch joins the buckets its
    keys fall into with the new records and runs the batch engine, so a hot key is blocked and spread exactly as in
    batch, and keys without new records cost nothing. Results and state carry the batch number: a repeated batch rewrites its own files only.
    """
    def write(batch: DataFrame, number: int) -> None:
        store = KeyedState(batch.sparkSession, state, key, buckets)
        touched = store.touched(batch)
        held = store.read(number - 1, touched, batch.schema)
        new = batch.withColumn("_new", F.lit(True))
        both = new if held is None else new.unionByName(held.withColumn("_new", F.lit(False)))
        D.detect(both, names, keys=(key,), limit=limit).where("_new").drop("_new").write.mode("overwrite").parquet(f"{out}/batch={number}")
        # rates look back twice as far, at every tenth row: whole tens are dropped, so that positions keep their remainder
        kept = H.index_rows(both.drop("_new"), [key]).where(F.expr(f"rn > (greatest(key_rows - {2 * limit - 1}, 0) DIV 10) * 10")).drop("rn", "key_rows")
        store.write(number, touched, kept)

    q = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (q.trigger(availableNow=True) if once else q).start()


def trust_stream(feedback: DataFrame, key: str = "function_id", initial: float = 0.8) -> DataFrame:
    """Trust after each verdict as keyed state; input columns: key, ts_us, event_id, trust_delta."""
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("trust", T.DoubleType()), T.StructField("position", T.LongType())])
    kept = T.StructType([T.StructField("trust", T.DoubleType()), T.StructField("n", T.LongType())])

    def step(k: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trust, n = state.get if state.exists else (initial, 0)
        rows = pd.concat(list(parts)).sort_values(["ts_us", "event_id"])
        trusts = []
        for d in rows["trust_delta"]:
            trust = min(1.0, max(0.1, trust + d))
            trusts.append(trust)
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "trust": trusts, "position": range(n + 1, n + 1 + len(rows))})
        state.update((trust, n + len(rows)))

    return feedback.select(key, "ts_us", "event_id", "trust_delta").groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


# --- fixed values: fallback triggers and delays in seconds ---
SILENCE_S, MISSING_S, COOLDOWN_S, HYSTERESIS_S = 5, 3, 30, 10
ERROR_WINDOW_S, ERROR_RATE, MIN_ERRORS = 30, 0.2, 3
PERFORMANCE_WINDOW_S, LOW_PERFORMANCE, MIN_POINTS = 60, 0.5, 10
LOW_QOS, QOS_STEP, HEALTHY_QOS = 0.3, 0.1, 0.4


def fallback_seconds(events: DataFrame, key: str, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """What happened per key and second: all that the fallback rules look at. Partial sums meet, so a busy key is one row a second.

    ``events`` has key, time, kind (telemetry, trace or side), is_error, performance and channel with qos (null where a record has none).
    Of several qos values of a channel in a second the lowest counts.
    """
    part = F.window(time, "1 second").alias("w")
    qos = F.map_from_entries(F.collect_list(F.when(F.col("channel").isNotNull() & F.col("low").isNotNull(), F.struct("channel", "low"))))
    each = (_marked(events, time, lateness) if events.isStreaming else events).groupBy(part, key, "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "trace").alias("traces"), F.count_if(F.col("kind") == "side").alias("sides"), F.count_if("is_error").alias("errors"),
        F.count("performance").alias("points"), F.sum("performance").alias("performance"), F.min("qos").alias("low"))
    sums = [F.sum(c).alias(c) for c in ("n", "traces", "sides", "errors", "points", "performance")]
    return each.groupBy("w", key).agg(*sums, qos.alias("qos"))


class Fallback:
    """The fallback rules of one key, stepped second by second."""

    def __init__(self, kept: str | None = None) -> None:
        import json

        d = json.loads(kept) if kept else {}
        self.mode, self.trigger = d.get("mode", "NORMAL"), d.get("trigger")
        self.cooldown, self.hysteresis = d.get("cooldown", -1), d.get("hysteresis", -1 << 40)
        self.now, self.last = d.get("now"), d.get("last", {})  # last second with any record, a trace, a side record
        self.recent = [tuple(r) for r in d.get("recent", [])]  # (tick, records, errors, points, performance) of the last minute
        self.qos, self.checked = d.get("qos", {}), d.get("checked", {})

    def keep(self) -> str:
        import json

        return json.dumps(self.__dict__)

    def tick(self, t: int) -> tuple | None:
        """Check the conditions at second t; the change it makes, if any."""
        self.now = t
        self.recent = [r for r in self.recent if t - r[0] < PERFORMANCE_WINDOW_S]
        if t < self.cooldown:
            return None
        low = [c for c, q in self.qos.items() if q < LOW_QOS and abs(q - self.checked.get(c, 1.0)) > QOS_STEP]
        silent = "any" in self.last and t - self.last["any"] > SILENCE_S
        points, total = sum(r[3] for r in self.recent), sum(r[4] for r in self.recent)
        near = [r for r in self.recent if t - r[0] < ERROR_WINDOW_S]
        errors, n = sum(r[2] for r in near), sum(r[1] for r in near)
        trigger, target = None, "DEGRADED"
        if silent:
            trigger = "no_telemetry"
        elif any(k in self.last and t - self.last[k] > MISSING_S for k in ("trace", "side")):
            trigger = "data_missing"
        elif points >= MIN_POINTS and round(total / points, 9) < LOW_PERFORMANCE:  # the order of a sum decides nothing
            trigger = "performance"
        elif errors >= MIN_ERRORS and errors / n > ERROR_RATE:
            trigger = "error_rate"
        else:
            self.checked = dict(self.qos)  # channels are looked at only when nothing before them fires
            if low:
                if any(q >= HEALTHY_QOS for c, q in self.qos.items() if c not in low):
                    return None  # another channel takes over
                trigger, target = "channel_degradation", "EMERGENCY"
        before = (self.mode, self.trigger)
        if trigger:
            self.mode, self.trigger, self.cooldown, self.hysteresis = target, trigger, t + COOLDOWN_S, t
        elif self.mode != "NORMAL" and t >= self.hysteresis + HYSTERESIS_S:
            self.mode, self.trigger = "NORMAL", None
        return None if (self.mode, self.trigger) == before else (t, before[0], self.mode, self.trigger or "recovered")

    def wait(self, until: int) -> list[tuple]:
        """The ticks before second ``until``. Once nothing but silence is left, whole cooldowns are skipped: each only repeats itself."""
        out = []
        while self.now is not None and self.now + 1 < until:
            if self.trigger == "no_telemetry" and not self.recent and self.now >= self.cooldown - COOLDOWN_S:
                t = self.cooldown + (max(until - 1 - self.cooldown, 0) // COOLDOWN_S) * COOLDOWN_S
                if self.cooldown < until:
                    self.cooldown, self.hysteresis = t + COOLDOWN_S, t
                self.now = until - 1
                break
            out.append(self.tick(self.now + 1))
        return [x for x in out if x]

    def read(self, second: int, row: Any) -> list[tuple]:
        """The records of one second; they are checked at its end."""
        out = self.wait(second + 1)
        for name, count in (("any", row.n), ("trace", row.traces), ("side", row.sides)):
            if count:
                self.last[name] = second + 1
        self.recent.append((second + 1, int(row.n), int(row.errors), int(row.points), float(row.performance) if row.points else 0.0))
        self.qos.update(dict(row.qos or {}))
        found = self.tick(second + 1)
        return out + [found] if found else out

    def due(self) -> int | None:
        """The second until which the rules must be looked at without any further record; None once only silence repeats itself."""
        if self.trigger == "no_telemetry" and not self.recent:
            return None
        return None if self.now is None else max(self.now + 1, self.cooldown)


def fallback_stream(events: DataFrame, key: str = "function_id", time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """(key, second, previous, mode, reason): changes of the fallback mode of each key, noticed also while no record arrives.

    At the end of every second the triggers are tested in order: no record for more than 5 s; no trace or no side record for more than 3 s (of kinds the key
    has had); mean performance, to nine decimals, below .5 (60 s, ten points at least); more than 20% errors (30 s, three errors at least); a channel whose quality fell
    by more than .1 to below .3. The last one leads to EMERGENCY unless another channel is at .4 or better, the others to DEGRADED. Then 30 s of
    cooldown follow; back to NORMAL when no trigger holds, ten seconds after the last one at the earliest. A trigger that only repeats is no change.
    Records are summed per second before they reach the state, which holds a minute of such sums; seconds without records are
    stepped through by event-time timers, so the watermark alone moves a silent key on. Timers need the RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("second", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("reason", T.StringType())])
    kept = T.StructType([T.StructField("kept", T.StringType())])

    class Rules(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("rules", kept)

        def _rules(self) -> Fallback:
            return Fallback(self.state.get()[0] if self.state.exists() else None)

        def _close(self, k: Any, rules: Fallback, changes: list[tuple]) -> Iterator[pd.DataFrame]:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            due = rules.due()
            if due is not None:
                self.handle.registerTimer(due * 1_000)
            self.state.update((rules.keep(),))
            yield pd.DataFrame([(k[0], *c) for c in changes], columns=out.names)

        def handleInputRows(self, k: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
            rules, changes = self._rules(), []
            each = pd.concat(list(rows))  # one row per second, and a batch's seconds of one key only
            for row in each.sort_values("second").itertuples():
                changes += rules.read(row.second, row)
            yield from self._close(k, rules, changes)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            rules = self._rules()
            changes = rules.wait(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1_000 + 1)
            yield from self._close(key, rules, changes)

        def close(self) -> None:
            pass

    seconds = fallback_seconds(events, key, time, lateness)
    flat = seconds.select(key, F.unix_seconds("w.start").alias("second"), "n", "traces", "sides", "errors", "points", "performance", "qos", F.window_time("w").alias("at"))
    return flat.groupBy(key).transformWithStateInPandas(Rules(), out, "Append", "EventTime")
