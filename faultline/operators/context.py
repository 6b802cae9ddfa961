"""Window context shared by the history detectors.

``build`` adds only the columns the chosen detectors declare in ``needs``. All of them live in
one (key, block) partitioning: one exchange for the whole detector engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators import history as H

SEC = 1_000_000
#: time look-backs in microseconds. A row is outside once it is that old, so a window that
#: includes its far edge ends one microsecond later.
AGES = {
    "a3600": 3600 * SEC,
    "a3600i": 3600 * SEC + 1,
    "a600i": 600 * SEC + 1,
    "a300i": 300 * SEC + 1,
    "a10i": 10 * SEC + 1,
    "a5i": 5 * SEC + 1,
}
ERR = "(execution_phase = 'error' OR anomaly_type IN ('execution_failure', 'timeout_fallback'))"
PHASE_SLOTS = ("init", "invoke", "shutdown", "error", "timeout")


def build(df: DataFrame, needs: Iterable[str], keys: Sequence[str] = ("function_id",),
          limit: int = H.HISTORY, block: int = H.BLOCK, used: dict[str, set[str]] | None = None) -> DataFrame:
    """``used`` names the fields that are read of each sum (p, ph, half, base, recent and the look-backs); none other is kept."""
    needs, keys = set(needs), list(keys)
    if not needs:
        return df
    ages = {n for n in needs if n in AGES} | ({"a300i"} if "samples" in needs else set())
    if ages or needs & {"half", "drift"}:
        needs.add("sums")
    if "a300i" in ages or "a600i" in ages:
        needs.add("fails")

    # sampled rates look at each sample's own history, so they reach twice as far
    reach = 2 * limit - 1 if "samples" in needs else limit
    rows = df
    df = H.blocked(df, keys, reach, max(block, reach))
    part = [*keys, "blk"]
    if not rows.isStreaming:
        df = H.one_block_a_task(rows, df, keys, max(block, reach))
        part = ["_task", *part]  # else the windows would bring the blocks together by a hash again
    w = W.partitionBy(*part).orderBy("rn")
    grow = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("n", F.least(F.col("rn"), F.lit(limit)))

    small: dict[str, Column] = {}
    if "prev" in needs or "gaps" in needs:
        small["prev_ts"] = F.lag("ts_us").over(w)
    if "cpu5" in needs:
        small["cpu5"] = F.avg("cpu_utilization").over(w.rowsBetween(-4, 0))
    if "net5" in needs:
        small["net5"] = F.avg("network_io_bytes").over(w.rowsBetween(-4, 0))
    if "net10" in needs:
        small["net10"] = F.avg("network_io_bytes").over(w.rowsBetween(-9, 0))
    if "mem10" in needs:
        ten = w.rowsBetween(-9, 0)
        small["mem10"] = F.avg("memory_spike_kb").over(ten)
        small["mem10_slope"] = F.regr_slope(F.col("memory_spike_kb").cast("double"), F.col("rn").cast("double")).over(ten)
        small["prev_mem"] = F.lag("memory_spike_kb").over(w)
    if "dur20" in needs:
        small["dur20_slope"] = F.regr_slope(F.col("duration"), F.col("rn").cast("double")).over(w.rowsBetween(-19, 0))
    if "fails" in needs:
        small["prev_fail_ts"] = F.last(F.when(F.expr(f"{ERR} OR duration > 30"), F.col("ts_us")), ignorenulls=True).over(
            w.rowsBetween(W.unboundedPreceding, -1))
    if needs & {"sums", "hour", "phase"}:
        for short, name in (("d0", "duration"), ("m0", "memory_spike_kb"), ("c0", "cpu_utilization"), ("w0", "network_io_bytes")):
            small[short] = F.first(F.col(name).cast("double")).over(grow)
    df = df.withColumns(small) if small else df

    if "mem10" in needs:
        df = df.withColumn("mem_rises", F.sum(F.expr("CAST(memory_spike_kb > prev_mem AS INT)")).over(w.rowsBetween(-8, 0)))
    if "gaps" in needs:
        df = df.withColumn("_gap", (F.col("ts_us") - F.col("prev_ts")) / SEC)
        last19 = w.rowsBetween(-18, 0)
        df = df.withColumns({"gap_avg": F.avg("_gap").over(last19), "gap_std": F.stddev_pop("_gap").over(last19)})
    if "max_dur" in needs:
        df = _max_in_history(df, part, w, limit)
    if "fails" in needs:
        df = _failures(df, part, grow)
    if "sums" in needs:
        df, of = _sums(df, w, grow, limit, "fails" in needs, used)
    if ages:
        df = H.look_back(df, part, "ts_us", "p", {a: AGES[a] for a in sorted(ages)}, fields={a: of(a) for a in ages})
        # a look-back never reaches past the history limit
        df = df.withColumns({
            a: F.when(F.col("ph").isNull() | (F.col(f"{a}.n") >= F.col("ph.n")), F.col(a)).otherwise(_fields("ph", of(a)))
            for a in ages
        })
    if "samples" in needs:
        df = _samples(df, w, grow, limit)
    block_end = F.least(F.col("key_rows"), (F.col("blk") + 1) * max(block, reach))
    if "hour" in needs:
        df = df.withColumn("hour", F.expr("ts_us DIV 3600000000 % 24"))
        df = _category(df, part, "hour", "hh", limit, block_end)
    if "phase" in needs:
        df = _category(df, part, "execution_phase", "pp", limit, block_end)
    if "half" in needs:
        df = df.withColumn("_half", F.lag(_fields("p", of("half")), limit // 2).over(w))
        df = H.look_at(df, part, "half", F.expr(f"CASE WHEN rn <= {limit} THEN rn DIV 2 END"),
                       F.col("rn") <= limit // 2, "p", of("half"))
        df = df.withColumn("half", F.coalesce("half", "_half")).drop("_half")
    if "drift" in needs:
        df = df.withColumns({"_r20": F.lag(_fields("p", of("recent")), 20).over(w), "_b30": F.lag(_fields("p", of("base")), max(limit - 30, 0)).over(w)})
        df = H.look_at(df, part, "base", F.expr(f"CASE WHEN rn BETWEEN 50 AND {limit} THEN least(30, rn DIV 2) END"),
                       F.col("rn").between(25, 30), "p", of("base"))
        df = H.look_at(df, part, "recent", F.expr("CASE WHEN rn BETWEEN 50 AND 79 THEN rn - rn DIV 4 END"),
                       F.col("rn").between(38, 60), "p", of("recent"))
        df = df.withColumns({
            "base": F.when(F.col("rn") <= limit, F.col("base")).otherwise(F.col("_b30")),
            "recent": F.when(F.col("rn") < 80, F.col("recent")).otherwise(F.col("_r20")),
        }).drop("_r20", "_b30")
    if "pct" in needs:
        group = F.xxhash64(*[F.col(k) for k in part])
        if needs == {"pct"} and "_task" not in part:  # no window has brought the blocks together yet
            df = df.repartition(*[F.col(k) for k in part])
        df = df.sortWithinPartitions(*part, "rn").withColumn("q", H.rolling_quantiles(limit)(
            group, F.col("rn"), F.col("duration"), F.col("network_io_bytes").cast("double")))
    return df.where(~F.col("halo"))


def _max_in_history(df, part, w, limit):
    """Maximum of the last ``limit`` durations from two running maxima over aligned chunks.

    The frame spans at most two chunks of ``limit`` rows: the running maximum of this row's
    chunk, and the suffix maximum of the previous chunk from the frame's start on.
    """
    df = df.withColumn("_chunk", F.expr(f"rn DIV {limit}"))
    chunk = W.partitionBy(*part, "_chunk")
    df = df.withColumns({
        "_head": F.max("duration").over(chunk.orderBy("rn").rowsBetween(W.unboundedPreceding, 0)),
        "_tail": F.max("duration").over(chunk.orderBy(F.desc("rn")).rowsBetween(W.unboundedPreceding, 0)),
    })
    return df.withColumn("max_dur", F.greatest("_head", F.lag("_tail", limit - 1).over(w))).drop("_head", "_tail", "_chunk")


def _failures(df, part, grow):
    """Failure index, and flags of failures that follow the previous one within 30 seconds."""
    fail = f"({ERR} OR duration > 30)"
    df = df.withColumns({
        "fail": F.expr(f"CAST({fail} AS INT)"),
        "rapid": F.expr(f"CAST({fail} AND coalesce(ts_us - prev_fail_ts < {30 * SEC}, false) AS INT)"),
    })
    later = W.partitionBy(*part).orderBy(F.desc("rn")).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({
        "f_idx": F.sum("fail").over(grow),
        "next_rapid": F.coalesce(F.last(F.when(F.col("fail") == 1, F.col("rapid")), ignorenulls=True).over(later), F.lit(0)),
    })


def _fields(struct: str, names: Iterable[str]) -> Column:
    return F.struct(*[F.col(f"{struct}.{x}").alias(x) for x in names])


def _sums(df, w, grow, limit, fails, used):
    """Running sums ``p`` over the block and ``ph``, the same just before the history starts; also which fields are read of each.

    Values are taken relative to the block's first row, so that differences of sums stay exact
    for constant series and accurate for large offsets.
    """
    d, m, c, n = "(duration - d0)", "(memory_spike_kb - m0)", "(cpu_utilization - c0)", "(network_io_bytes - w0)"
    parts = {
        "n": "1D", "d": d, "m": m, "c": c, "w": n,
        "d2": f"{d} * {d}", "m2": f"{m} * {m}", "c2": f"{c} * {c}", "w2": f"{n} * {n}",
        "dm": f"{d} * {m}", "dc": f"{d} * {c}", "e": f"CAST({ERR} AS DOUBLE)",
        **{f"ph_{s}": f"CAST(execution_phase = '{s}' AS DOUBLE)" for s in PHASE_SLOTS},
    }
    if fails:
        parts |= {"f": "CAST(fail AS DOUBLE)", "fd": "fail * duration", "fx": "fail * f_idx * duration", "r": "CAST(rapid AS DOUBLE)"}
    every = [*parts, *(["r_from"] if fails else [])]
    of = lambda name: every if used is None else [x for x in every if x == "n" or x in used.get(name, ())]
    if used is not None:
        wanted = {"n"} | {x for names in used.values() for x in names}
        parts = {k: v for k, v in parts.items() if k in wanted or (k == "r" and "r_from" in wanted)}
        fails = "r_from" in wanted
    df = df.withColumns({f"_s_{k}": F.sum(F.expr(v)).over(grow) for k, v in parts.items()})
    fields = [F.col(f"_s_{k}").alias(k) for k in parts]
    if fails:
        fields.append((F.col("_s_r") + F.col("next_rapid")).alias("r_from"))
    df = df.withColumn("p", F.struct(*fields)).drop(*[f"_s_{k}" for k in parts])
    before = [x for x in every if x == "n" or any(x in of(name) for name in ("ph", *AGES)) and x in {*parts, "r_from"}]
    return df.withColumn("ph", F.lag(_fields("p", before), limit).over(w)), of


def _samples(df, w, grow, limit):
    """Invocations in five minutes, sampled at every tenth row from the 21st on, over the history.

    Counts, not rates, are summed: whole numbers keep the sums exact.
    """
    rate = F.expr("CASE WHEN rn >= 21 AND rn % 10 = 1 AND p.n - coalesce(a300i.n, 0) > 1 "
                  "THEN p.n - coalesce(a300i.n, 0) - 1 END")
    df = df.withColumn("_rate", rate)
    df = df.withColumns({
        "_k": F.count("_rate").over(grow),
        "_f": F.coalesce(F.sum("_rate").over(grow), F.lit(0.0)),
        "_f2": F.coalesce(F.sum(F.col("_rate") * F.col("_rate")).over(grow), F.lit(0.0)),
    })
    df = df.withColumn("_t", F.struct("_k", "_f", "_f2"))
    df = df.withColumn("_th", F.lag("_t", limit).over(w))
    k, f, f2 = (F.col(x) - F.coalesce(F.col(f"_th.{x}"), F.lit(0)) for x in ("_k", "_f", "_f2"))
    return df.withColumn("samples", F.struct(k.alias("k"), f.alias("f"), f2.alias("f2"))).drop(
        "_rate", "_k", "_f", "_f2", "_t", "_th")


def _category(df, part, cat, name, limit, block_end):
    """Count, sum and square sum of durations of the history rows that share ``cat``."""
    grow = W.partitionBy(*part, cat).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    rel = F.col("duration") - F.col("d0")
    df = df.withColumns({"_a": F.count(F.lit(1)).over(grow), "_b": F.sum(rel).over(grow), "_c2": F.sum(rel * rel).over(grow)})
    df = df.withColumn("_now", F.struct(F.col("_a").alias("k"), F.col("_b").alias("s"), F.col("_c2").alias("s2")))
    df = H.look_back(df, [*part, cat], "rn", "_now", {"_old": limit}, upto=block_end)
    val = [(F.col(f"_now.{x}") - F.coalesce(F.col(f"_old.{x}"), F.lit(0))).alias(x) for x in ("k", "s", "s2")]
    return df.withColumn(name, F.struct(*val)).drop("_a", "_b", "_c2", "_now", "_old")


# --- expressions over the context -------------------------------------------------------

def span(field: str, start: str = "ph") -> str:
    """SQL for a sum over the rows after ``start`` up to and including this one."""
    return f"(p.{field} - coalesce({start}.{field}, 0))"


def std(n: str, s: str, s2: str) -> str:
    """Population standard deviation from a count, a sum and a square sum."""
    n = f"nullif({n}, 0)"
    var = f"(({s2}) / {n} - (({s}) / {n}) * (({s}) / {n}))"
    return f"(CASE WHEN {var} <= 1e-12 * ({s2}) / {n} THEN 0D ELSE sqrt({var}) END)"
