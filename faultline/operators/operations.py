"""Data quality, component health, channels, adaptive sampling and metric summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators import history as H, trust
from faultline.operators.quantiles import exact_quantiles
from faultline.session import cut_lineage

# --- fixed values: weights, level bounds and alert bounds of the quality metrics ---
QUALITY_WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "timeliness": 0.15, "validity": 0.10, "integrity": 0.05}
QUALITY_LEVELS = ((0.95, "excellent"), (0.85, "good"), (0.75, "acceptable"), (0.60, "poor"))
QUALITY_ALERTS = {"completeness": 0.8, "accuracy": 0.8, "consistency": 0.8, "timeliness": 0.9, "validity": 0.8, "integrity": 0.9}


def _add(cols: Sequence[Column]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + c
    return total


def batch_quality(df: DataFrame, batch: str, required: Sequence[str], fields: Sequence[str], as_of: str, time: str = "ts_us") -> DataFrame:
    """Six quality metrics, overall score and level per batch, in one aggregation. ``as_of`` is SQL for now (µs)."""
    types = dict(df.dtypes)
    missing = _add([F.col(f).isNull().cast("int") for f in required])
    fine = _add([(F.trim(f) != "").cast("int") if types[f] == "string" else F.col(f).isNotNull().cast("int") for f in fields])
    odd = F.lit(False)
    for f in (f for f in fields if types[f] == "string"):
        odd = odd | (F.length(f) > 10000) | F.col(f).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    odd = F.coalesce(odd, F.lit(False))
    one = lambda c: F.coalesce(1 / F.nullif(F.count_distinct(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    out = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("records"),
        (1 - F.sum(missing) / (F.count(F.lit(1)) * len(required))).alias("completeness"),
        (F.sum(F.coalesce(fine, F.lit(0))) / (F.count(F.lit(1)) * len(fields))).alias("accuracy"),
        (one("schema_version") * 0.4 + one("anomaly_type") * 0.3 + one("execution_phase") * 0.3).alias("consistency"),
        F.avg((F.expr(as_of) - F.col(time) <= 300_000_000).cast("int")).alias("timeliness"),
        F.avg((missing == 0).cast("int")).alias("validity"),
        (1 - F.avg(odd.cast("int"))).alias("integrity"))
    score = _add([F.col(m) * w for m, w in QUALITY_WEIGHTS.items()])
    level = F.lit("unacceptable")
    for bound, name in reversed(QUALITY_LEVELS):
        level = F.when(F.col("overall") >= bound, name).otherwise(level)
    return out.withColumn("overall", score).withColumn("level", level)


def quality_alerts(quality: DataFrame, batch: str) -> DataFrame:
    long = quality.select(batch, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"), F.lit(t).alias("bound")) for m, t in QUALITY_ALERTS.items()])))
    return long.where("score < bound")


def quality_trend(quality: DataFrame, order: str, metrics: Sequence[str] = tuple(QUALITY_WEIGHTS)) -> DataFrame:
    """Direction (second half against first, 5%), strength and volatility of each metric over batches."""
    long = quality.select(order, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])))
    rows = H.index_rows(long, ["metric"], order, order, slot=64)
    half = F.col("rn") <= F.expr("key_rows DIV 2")
    out = rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("points"), F.avg("score").alias("average"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.stddev_pop("score").alias("volatility"), F.avg(F.when(half, F.col("score"))).alias("_first"), F.avg(F.when(~half, F.col("score"))).alias("_second"))
    return out.withColumns({
        "direction": F.expr("CASE WHEN points < 2 THEN 'stable' WHEN _second > _first * 1.05D THEN 'improving' WHEN _second < _first * 0.95D THEN 'declining' ELSE 'stable' END"),
        "strength": F.coalesce(F.least(F.lit(1.0), F.col("volatility") / F.nullif("average", F.lit(0.0))), F.lit(0.0)),
    }).drop("_first", "_second")


# --- health ---

BAD = ("failed", "critical")


def transitions(status: DataFrame, component: str, time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Status changes with their alert level; a component starts as unknown."""
    rows = H.with_previous(status, [component], ["status"], time=time, tie=tie)
    prev = F.coalesce("prev_status", F.lit("unknown"))
    return rows.withColumn("previous", prev).where(F.col("status") != F.col("previous")).drop("prev_status", "rn", "key_rows").withColumn(
        "alert", F.expr("CASE status WHEN 'failed' THEN 'critical' WHEN 'critical' THEN 'error' WHEN 'degraded' THEN 'warning' ELSE 'info' END"))


def incidents(changes: DataFrame, component: str, time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Incidents healthy -> failed/critical, closed first-in-first-out by failed/critical -> healthy.

    A recovery with no open incident closes nothing. The number of open incidents is a running
    sum that never drops below zero; the k-th effective recovery closes the k-th incident.
    """
    start = (F.col("previous") == "healthy") & F.col("status").isin(*BAD)
    end = F.col("previous").isin(*BAD) & (F.col("status") == "healthy")
    # used several times below: written once to the shared checkpoint folder
    steps = cut_lineage(changes.where(start | end).withColumn("d", F.when(start, 1.0).otherwise(-1.0)))
    open_after = trust.clipped_running_sum(steps, [component], time, tie, "d", 0.0, 0.0, 1e18)
    rows = steps.join(open_after, [component, tie])
    rows = cut_lineage(H.with_previous(rows, [component], ["running"], time=time, tie=tie).drop("rn", "key_rows", "position"))
    begun = H.index_rows(rows.where("d > 0"), [component], time, tie).select(component, "rn", F.col(time).alias("started"), F.col("status").alias("failure"))
    ended = H.index_rows(rows.where("d < 0 AND prev_running > 0"), [component], time, tie).select(component, "rn", F.col(time).alias("ended"))
    return begun.join(ended, [component, "rn"], "left")


def mttr(inc: DataFrame, component: str, target_s: float = 300.0, least: int = 3) -> DataFrame:
    """Recovery time per component with at least ``least`` closed incidents."""
    done = inc.where("ended IS NOT NULL").withColumn("recovery", (F.col("ended") - F.col("started")) / 1_000_000)
    stats = done.groupBy(component).agg(F.count(F.lit(1)).alias("incidents"), F.avg("recovery").alias("avg_s"), F.max("recovery").alias("max_s")).where(F.col("incidents") >= least)
    med = exact_quantiles(done, [component], "recovery", [0.5]).select(component, F.col("q").alias("median_s"))
    return stats.join(med, component).withColumn("meets_sla", F.col("avg_s") <= target_s)


def missed_heartbeats(beats: DataFrame, component: str, time: str = "ts_us", tie: str = "event_id", allowed_s: float = 3.0, dead_at: int = 3) -> DataFrame:
    """Gaps in which checks once a second found the last beat too old; dead from three misses on."""
    rows = H.with_previous(beats, [component], [time], time=time, tie=tie)
    gap = (F.col(time) - F.col(f"prev_{time}")) / 1_000_000
    missed = F.greatest(F.lit(0), F.floor(gap) - int(allowed_s)).cast("bigint")
    return rows.withColumns({"gap_s": gap, "missed": missed}).where("missed > 0").withColumn("dead", F.col("missed") >= dead_at).drop("rn", "key_rows", f"prev_{time}")


def system_health(status: DataFrame, component: str, time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Latest status of every component, rolled up: worst status and breakdown in one row."""
    latest = status.groupBy(component).agg(F.max_by("status", F.struct(time, tie)).alias("status"))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = latest.agg(F.count(F.lit(1)).alias("components"), n("failed"), n("critical"), n("degraded"), n("healthy"))
    return out.withColumn("overall", F.expr("CASE WHEN failed > 0 THEN 'failed' WHEN critical > 0 THEN 'critical' WHEN degraded > 0 THEN 'degraded' WHEN healthy > 0 THEN 'healthy' ELSE 'unknown' END"))


# --- channels ---

def channel_qos(df: DataFrame) -> DataFrame:
    """QoS of channels with ``latency_ms``, ``throughput``, ``availability`` and ``cost``."""
    return df.withColumn("qos", F.expr("""greatest(0D, least(1D, 0.4D * greatest(0D, 1 - latency_ms / 1000) + 0.3D * least(1D, throughput / 1000)
        + 0.2D * availability + 0.1D * (1 - cost * 1000)))"""))


def rank_channels(df: DataFrame, priority: str = "balanced", payload_size: int = 1024) -> DataFrame:
    if priority == "speed":
        df = df.where("qos >= 0.7D")
    elif priority == "ratio" and payload_size < 1024:
        df = df.where("false")
    elif priority == "cost":
        df = df.where("cost <= 0.01D")
    # --- fixed values: the recommendation texts ---
    text = F.expr("""CASE WHEN qos >= 0.9D THEN 'Primary channel - excellent performance' WHEN qos >= 0.7D THEN 'Secondary channel - good performance'
        WHEN qos >= 0.5D THEN 'Fallback channel - acceptable performance' ELSE 'Emergency channel - minimal performance' END""")
    if priority == "speed":
        text = F.concat(text, F.when(F.col("qos") >= 0.8, " - optimized for speed").otherwise(" - consider faster alternatives"))
    elif priority == "cost":
        text = F.concat(text, F.when(F.col("cost") < 0.001, " - low cost").when(F.col("cost") < 0.01, " - moderate cost").otherwise(" - high cost"))
    return df.withColumn("recommendation", text).orderBy(F.desc("qos"))


def failover_candidates(channels: DataFrame, keep: int = 1) -> DataFrame:
    """Healthy non-active channels, best health first, fewest failures next."""
    return channels.where("healthy AND NOT active").orderBy(F.desc("health"), "failures", "channel").limit(keep)


def channel_health(failures: DataFrame, channel: str = "channel", count: str = "failures") -> DataFrame:
    """Per-channel score and, on every row, the overall score with redundancy bonus."""
    per = failures.withColumn("health", F.greatest(F.lit(0.0), 1 - F.col(count) / 10))
    total = per.agg(F.least(F.lit(1.0), F.avg("health") + F.least(F.lit(0.2), F.count_if(F.col("health") > 0.7) * 0.05)).alias("overall"))
    return per.crossJoin(F.broadcast(total))  # one row


def loss_rate(sent: DataFrame, channel: str, lost: str, group: str) -> DataFrame:
    """Loss per channel in ppm against the loss when an event only counts as lost on all its channels."""
    one = sent.groupBy(channel).agg(F.count(F.lit(1)).alias("events"), F.sum(F.col(lost).cast("bigint")).alias("lost"))
    every = sent.groupBy(group).agg(F.min(F.col(lost).cast("int")).alias("all_lost")).agg((F.avg("all_lost") * 1e6).alias("multi_ppm"))
    out = one.withColumn("single_ppm", F.col("lost") / F.col("events") * 1e6).crossJoin(F.broadcast(every))  # one row
    return out.withColumns({
        "reduction_percent": F.when(F.col("single_ppm") > 0, (F.col("single_ppm") - F.col("multi_ppm")) / F.nullif("single_ppm", F.lit(0.0)) * 100),
        "factor": F.col("single_ppm") / F.greatest("multi_ppm", F.lit(0.001)),
    })


def outage_overlaps(outages: DataFrame, channel: str = "channel", start: str = "s", end: str = "e", slot: int = 600_000_000) -> DataFrame:
    """Pairs of outages of different channels that overlap.

    Each outage is listed in the time slots it covers; a pair is taken only in the slot where the
    later of the two begins, so no pair comes twice and no slot meets all outages.
    """
    a = outages.select(F.col(channel).alias("a"), F.col(start).alias("s1"), F.col(end).alias("e1")).withColumn(
        "slot", F.explode(F.sequence(F.expr(f"s1 DIV {slot}"), F.expr(f"e1 DIV {slot}"))))
    b = outages.select(F.col(channel).alias("b"), F.col(start).alias("s2"), F.col(end).alias("e2")).withColumn(
        "slot", F.explode(F.sequence(F.expr(f"s2 DIV {slot}"), F.expr(f"e2 DIV {slot}"))))
    both = a.join(b, "slot").where("a < b AND greatest(s1, s2) < least(e1, e2)")
    return both.where(F.col("slot") == F.expr(f"greatest(s1, s2) DIV {slot}")).drop("slot").withColumns({
        "overlap_start": F.greatest("s1", "s2"), "overlap_us": F.least("e1", "e2") - F.greatest("s1", "s2")})


def outage_cascades(outages: DataFrame, channel: str = "channel", start: str = "s", end: str = "e", window_us: int = 1_800_000_000) -> DataFrame:
    """Outages that begin within the window after another channel's; a range join on window-wide slots."""
    a = outages.select(F.col(channel).alias("trigger"), F.col(start).alias("s1"), F.col(end).alias("e1"))
    a = a.withColumn("slot", F.explode(F.array(F.expr(f"s1 DIV {window_us}"), F.expr(f"s1 DIV {window_us} + 1"))))
    b = outages.select(F.col(channel).alias("triggered"), F.col(start).alias("s2"), F.col(end).alias("e2")).withColumn("slot", F.expr(f"s2 DIV {window_us}"))
    return a.join(b, "slot").where(f"trigger <> triggered AND s2 > s1 AND s2 <= s1 + {window_us}").drop("slot").withColumn("delay_us", F.col("s2") - F.col("s1"))


def outage_correlation(outages: DataFrame, span_us: int | None = None, step_us: int = 360_000_000, channel: str = "channel", start: str = "s", end: str = "e") -> DataFrame:
    """Pearson correlation of the outage series of all pairs of channels with an outage on a time grid.

    For 0/1 series it follows from counts of grid points: per channel and per pair, none for a pair that is never out
    together. The grid reaches to the last end of an outage, or to ``span_us`` if that is later.
    """
    last = outages.agg(F.max(end)).first()[0] or 0  # one number
    n = max(-(-last // step_us), (span_us or 0) // step_us)
    grid = outages.select(F.col(channel).alias("ch"), F.expr(f"{start} DIV {step_us}").alias("i0"), F.expr(f"{end} DIV {step_us} - 1").alias("i1")).where("i1 >= i0")
    pts = grid.select("ch", F.explode(F.sequence("i0", "i1")).alias("i")).distinct()
    per = pts.groupBy("ch").agg(F.count(F.lit(1)).alias("k"))
    pair = pts.select(F.col("ch").alias("a"), "i").join(pts.select(F.col("ch").alias("b"), "i"), "i").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k2"))
    channels = per.select(F.col("ch").alias("a"), F.col("k").alias("ka")).join(per.select(F.col("ch").alias("b"), F.col("k").alias("kb")), F.expr("a < b"))
    out = channels.join(pair, ["a", "b"], "left").withColumn("k2", F.coalesce("k2", F.lit(0)))
    return out.withColumn("corr", F.expr(f"({n} * k2 - ka * kb) / sqrt(CAST(ka AS DOUBLE) * ({n} - ka) * kb * ({n} - kb))"))


def majority_vote(replicas: DataFrame, item: str, value: str) -> DataFrame:
    """Most frequent value per item; equal counts: the smaller value."""
    counts = replicas.groupBy(item, value).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(item).agg(F.min(F.struct((-F.col("votes")).alias("o"), F.col(value).alias("v"))).alias("m"), F.sum("votes").alias("replicas"))
    return best.select(item, F.col("m.v").alias("consensus"), (-F.col("m.o")).alias("votes"), "replicas")


def channel_success(df: DataFrame, channel: str, ok: str, latency: str) -> DataFrame:
    good = df.where(ok)
    stats = df.groupBy(channel).agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr(f"CAST({ok} AS INT)")).alias("success_rate"))
    lat = good.groupBy(channel).agg(F.avg(latency).alias("mean_latency"), (F.stddev_pop(latency) / F.avg(latency)).alias("stability"))
    p99 = exact_quantiles(good, [channel], latency, [0.99]).select(channel, F.col("q").alias("p99_latency"))
    return stats.join(lat, channel, "left").join(p99, channel, "left")


# --- adaptive sampling ---

def sampling_profile(df: DataFrame, keys: Sequence[str] = ("function_id",), limit: int = 1000) -> DataFrame:
    """Running profile of each key up to and including this record (averages, p95 of the last ``limit``)."""
    rows = H.blocked(df, keys, limit)
    part = [*keys, "blk"]
    w = W.partitionBy(*part).orderBy("rn")
    grow = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        "prev_ts": F.lag("ts_us").over(w),
        "_d": F.sum("duration").over(grow), "_d2": F.sum(F.col("duration") * F.col("duration")).over(grow), "_m": F.sum("memory_spike_kb").over(grow),
        "_c": F.sum("cpu_utilization").over(grow)})
    rows = rows.withColumn("_p", F.struct("_d", "_d2", "_m", "_c")).withColumn("_o", F.lag("_p", limit).over(w))
    n = F.least(F.col("rn"), F.lit(limit))
    val = lambda k: F.col(f"_p.{k}") - F.coalesce(F.col(f"_o.{k}"), F.lit(0))
    rows = rows.withColumns({
        "n": F.col("rn"), "avg_duration": val("_d") / n, "avg_memory": val("_m") / n, "avg_cpu": val("_c") / n,
        "var_duration": F.greatest(F.lit(0.0), (val("_d2") - val("_d") * val("_d") / n) / F.nullif(n - 1, F.lit(0)))})
    rows = rows.sortWithinPartitions(*part, "rn").withColumn("q", H.rolling_quantiles(limit)(
        F.xxhash64(*part), F.col("rn"), F.col("duration"), F.col("network_io_bytes").cast("double")))
    return rows.where(~F.col("halo")).withColumn("p95_duration", F.col("q.p95")).drop("q", "_d", "_d2", "_m", "_c", "_p", "_o", "halo", "blk", "key_rows", "rn")


def execution_state(prof: DataFrame) -> DataFrame:
    """Cold, warm, high-latency, memory, cpu or hot; and the first profile anomaly."""
    idle = "coalesce((ts_us - prev_ts) / 1000000, 0)"
    return prof.withColumns({
        "state": F.expr(f"""CASE WHEN {idle} > 300 OR memory_spike_kb < 0.5D * avg_memory OR memory_spike_kb > 2 * avg_memory THEN 'cold_start'
            WHEN {idle} BETWEEN 30 AND 300 THEN 'warm_start' WHEN p95_duration > 0 AND duration > p95_duration * 1.5D THEN 'high_latency'
            WHEN memory_spike_kb > avg_memory * 1.3D THEN 'memory_pressure' WHEN cpu_utilization > 80 THEN 'cpu_intensive' ELSE 'hot_execution' END"""),
        "profile_anomaly": F.expr("""CASE WHEN p95_duration > 0 AND duration > p95_duration * 2 THEN 'latency_spike'
            WHEN avg_memory > 0 AND memory_spike_kb > avg_memory * 1.5D THEN 'memory_spike' WHEN avg_cpu > 0 AND cpu_utilization > avg_cpu * 2 THEN 'cpu_spike'
            WHEN execution_phase = 'error' AND 1 / least(n, 100) > 0.1 THEN 'error_rate_increase' END"""),
    })


def adaptive_sample(states: DataFrame, base: float = 0.1, low: float = 0.01, high: float = 1.0, learn_after: int = 100, strategy: str = "adaptive",
                    keys: Sequence[str] = ("function_id",), id_col: str = "event_id") -> DataFrame:
    """Sampling rate of each record and whether it is kept: its id hash falls below the rate."""
    f = {
        "adaptive": """CASE state WHEN 'cold_start' THEN 5D WHEN 'warm_start' THEN 2.5D WHEN 'high_latency' THEN 3D WHEN 'memory_pressure' THEN 2D WHEN 'cpu_intensive' THEN 2D ELSE 1D END""",
        "threshold": "CASE state WHEN 'cold_start' THEN 5D WHEN 'high_latency' THEN 2D ELSE 1D END",
        "fixed": "1D",
    }[strategy]
    rate = F.least(F.lit(1.0), F.expr(f"{base}D * {f}"))
    if strategy != "fixed":
        rate = F.least(F.lit(1.0), rate * F.expr("CASE WHEN profile_anomaly IS NOT NULL THEN 3D ELSE 1D END"))
    if strategy == "adaptive":
        states = H.running_total(states, list(keys), {"anomaly_count": F.col("profile_anomaly").isNotNull().cast("bigint")})
        rate = F.least(F.lit(1.0), rate * F.expr(f"CASE WHEN n > {learn_after} AND anomaly_count / n > 0.1 THEN 1.5D ELSE 1D END"))
        rate = F.least(F.lit(1.0), rate * F.expr(f"CASE WHEN n > {learn_after} AND var_duration > pow(avg_duration * 0.5D, 2) THEN 1.3D ELSE 1D END"))
    rate = F.greatest(F.lit(low), F.least(F.lit(high), rate))
    return states.withColumn("sample_rate", rate).withColumn("sampled", F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.col("sample_rate") * 1_000_000)


# --- metrics ---

def metric_summary(long: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value", probs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    stats = long.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"),
                                    F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    q = exact_quantiles(long, keys, value, probs).groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(p * 100)}") for p in probs])
    return stats.join(q, list(keys))


def throughput(df: DataFrame, seconds: int = 60, time: str = "ts_us") -> DataFrame:
    """Operations per second in each window of ``seconds``."""
    return df.groupBy(F.expr(f"{time} DIV {seconds * 1_000_000}").alias("slot")).agg((F.count(F.lit(1)) / seconds).alias("ops_per_s"))
