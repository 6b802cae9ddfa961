"""Temporal properties of traces, and integrity of record batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators import history as H, signing
from faultline.session import cut_lineage

# --- fixed values: state predicates ---
PREDICATES = {
    "complete": "duration > 0",
    "error": "execution_phase = 'error' OR anomaly_type IN ('execution_failure', 'timeout_fallback')",
    "cold_start": "execution_phase = 'init'",
    "warm": "execution_phase <> 'init'",
    "timeout": "anomaly_type = 'timeout_fallback'",
    "high_memory": "memory_spike_kb > 102400",
    "high_duration": "duration > 10",
    "responsive": "duration < 5",
    "memory_under_512": "memory_spike_kb / 1024 < 512",
}


def memory_under(mb: int) -> str:
    return f"memory_spike_kb / 1024 < {mb}"


# A finite trace needs no window for these: F p is "some state", G p "all states", a bare p "the
# first state" and G F p "the last state". All are plain aggregates, combined map-side, so a
# trace of any length costs one small buffer per task.
def first(p: str, at: Column) -> Column:
    return F.min_by(F.expr(p), at)


def last(p: str, at: Column) -> Column:
    return F.max_by(F.expr(p), at)


def eventually(p: str) -> Column:
    return F.max(F.expr(p))


def always(p: str) -> Column:
    return F.min(F.expr(p))


def next_state(p: str, at: Column) -> Column:
    """X p at the first state; false when the trace has one state."""
    return F.coalesce(F.element_at(F.min(F.when(F.col("_pos") == 2, F.array(F.expr(p)))), 1), F.lit(False))


def until(p: str, q: str) -> Column:
    """p U q: the first q comes no later than the first state without p, and it comes."""
    fq, fp = F.min(F.when(F.expr(q), F.col("_pos"))), F.min(F.when(~F.expr(p), F.col("_pos")))
    return F.coalesce(fq <= F.coalesce(fp, F.lit(2**62)), F.lit(False))


def _properties(at: Column) -> dict[str, tuple[str, Column, Column | None]]:
    """name -> (type, satisfied, position of the first counterexample where one state shows it)."""
    p = {k: f"({v})" for k, v in PREDICATES.items()}
    bad = lambda c: F.min(F.when(~F.expr(c), F.col("_pos") - 1))
    both, conflict = f"NOT ({p['cold_start']} AND {p['warm']})", f"NOT ({p['error']} AND {p['complete']})"
    return {
        "eventual_completion": ("completeness", eventually(p["complete"]), None),
        "no_infinite_errors": ("liveness", ~always(p["error"]), None),
        "cold_start_warmup": ("liveness", ~first(p["cold_start"], at) | eventually(p["warm"]), None),
        "memory_bounds": ("safety", always(p["memory_under_512"]), bad(p["memory_under_512"])),
        "no_simultaneous_states": ("safety", always(both), bad(both)),
        "error_implies_no_completion": ("safety", always(conflict), bad(conflict)),
        "eventual_response": ("liveness", ~first(p["error"], at) | eventually(p["responsive"]), None),
        "timeout_recovery": ("liveness", ~first(p["timeout"], at) | eventually(f"({p['complete']} OR {p['error']})"), None),
        "error_before_timeout": ("causality", ~always(p["error"]) | eventually(p["timeout"]), None),
        "memory_spike_completion": ("causality", ~first(p["high_memory"], at) | eventually(f"NOT {p['high_memory']}"), None),
        "infinite_responsiveness": ("liveness", last(p["responsive"], at), None),
        "bounded_duration": ("fairness", ~last(p["high_duration"], at), None),
    }


def verify_traces(df: DataFrame, trace: str, time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """One row per trace and property."""
    rows = H.index_rows(df, [trace], time, tie).withColumnRenamed("rn", "_pos")
    props = _properties(F.col("_pos"))
    wide = rows.groupBy(trace).agg(*[ok.alias(n) for n, (_, ok, _) in props.items()], *[b.alias(f"{n}_at") for n, (_, _, b) in props.items() if b is not None])
    none = F.lit(None).cast("bigint")
    return wide.select(trace, F.inline(F.array(*[F.struct(
        F.lit(n).alias("property"), F.lit(kind).alias("type"), F.col(n).alias("satisfied"), (F.col(f"{n}_at") if b is not None else none).alias("counterexample"))
        for n, (kind, _, b) in props.items()])))


def verify_dataset(df: DataFrame, trace: str, **kw) -> DataFrame:
    """Satisfaction rate per property."""
    v = verify_traces(df, trace, **kw)
    return v.groupBy("property", "type").agg(F.count(F.lit(1)).alias("traces"), F.count_if("satisfied").alias("satisfied"), F.avg(F.col("satisfied").cast("int")).alias("rate"))


def check_formula(df: DataFrame, trace: str, formulas: dict[str, Column], time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """User formulas built from ``first``, ``last``, ``eventually``, ``always``, ``next_state`` and ``until``; position column ``_pos``."""
    rows = H.index_rows(df, [trace], time, tie).withColumnRenamed("rn", "_pos")
    return rows.groupBy(trace).agg(*[c.alias(n) for n, c in formulas.items()])


# --- integrity ---

_LEVEL = "transform(sequence(0, (size({0}) + 1) DIV 2 - 1), i -> sha2(concat({0}[2 * i], coalesce(get({0}, 2 * i + 1), {0}[2 * i])), 256))"
FAN = 256


def merkle_roots(leaves: DataFrame, batch: str, position: str, digest: str) -> DataFrame:
    """Merkle root per batch: pairwise SHA-256, an odd last node is paired with itself.

    Aligned runs of 256 nodes are folded eight levels at a time, so a batch of any size needs
    log256(n) rounds and no task holds more than 256 digests of a batch.
    """
    sizes = leaves.groupBy(batch).agg((F.max(position) + 1).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0  # one number, to know the number of rounds
    nodes = leaves.select(batch, F.col(position).alias("_i"), F.col(digest).alias("_h")).join(sizes, batch)
    while True:
        runs = nodes.groupBy(batch, "_n", F.expr(f"_i DIV {FAN}").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]).alias("_l"))
        left = F.col("_n")
        for _ in range(8):
            runs = runs.withColumn("_l", F.when(left > 1, F.expr(_LEVEL.format("_l"))).otherwise(F.col("_l"))).withColumn("_n", F.ceil(left / 2))
        nodes = runs.select(batch, F.col("_b").alias("_i"), F.col("_l")[0].alias("_h"), "_n")
        largest = -(-largest // FAN)
        if largest <= 1:
            return nodes.select(batch, F.col("_h").alias("merkle_root"))


def merkle_proofs(leaves: DataFrame, batch: str, position: str, digest: str) -> DataFrame:
    """Siblings of each leaf, bottom up, and the root of its batch, for batches of any size.

    Runs of 256 nodes are folded eight levels at a time, as in `merkle_roots`. A leaf's proof is its path in its run
    followed by the path of the run's root one step up, so a run hears of what lies above it once, before it is taken
    apart: digests are shuffled as nodes of a run, proofs never.
    """
    sizes = leaves.groupBy(batch).agg((F.max(position) + 1).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0  # one number, to know the number of rounds
    nodes = leaves.select(batch, F.col(position).alias("_i"), F.col(digest).alias("_h")).join(sizes, batch)
    rounds = []
    while True:
        runs = nodes.groupBy(batch, F.expr(f"_i DIV {FAN}").alias("_b")).agg(
            F.max("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]).alias("l0"))
        rounds.append(runs)
        largest = -(-largest // FAN)
        if largest <= 1:
            break
        top = runs.withColumn("_l", F.col("l0"))
        for _ in range(8):
            top = top.withColumn("_l", F.when(F.col("_n") > 1, F.expr(_LEVEL.format("_l"))).otherwise(F.col("_l"))).withColumn("_n", F.ceil(F.col("_n") / 2))
        nodes = cut_lineage(top.select(batch, F.col("_b").alias("_i"), F.col("_l")[0].alias("_h"), "_n"))  # a 256th of the nodes below
    above = None
    at = lambda k: f"(i DIV {2 ** k})"
    steps = [F.expr(f"""CASE WHEN n{k} > 1 THEN named_struct('sibling', coalesce(get(l{k}, CAST({at(k)} + 1 - 2 * ({at(k)} % 2) AS INT)), l{k}[{at(k)}]),
        'direction', CASE WHEN {at(k)} % 2 = 0 THEN 'right' ELSE 'left' END) END""") for k in range(8)]
    for runs in reversed(rounds):
        left = F.col("_n")
        for k in range(8):
            runs = runs.withColumn(f"n{k}", left).withColumn(f"l{k + 1}", F.when(left > 1, F.expr(_LEVEL.format(f"l{k}"))).otherwise(F.col(f"l{k}"))).withColumn("_n", F.ceil(left / 2))
        if above is None:
            runs = runs.withColumns({"root": F.col("l8")[0], "_up": F.array().cast("array<struct<sibling:string,direction:string>>")})
        else:
            runs = runs.join(above, [batch, "_b"])
        wide = runs.select(batch, "_b", "root", "_up", F.posexplode("l0").alias("i", "leaf"), *[f"l{k}" for k in range(8)], *[f"n{k}" for k in range(8)])
        out = wide.select(batch, (F.col("_b") * FAN + F.col("i")).alias(position), "leaf", "root", F.concat(F.array_compact(F.array(*steps)), "_up").alias("proof"))
        above = out.select(batch, F.col(position).alias("_b"), "root", F.col("proof").alias("_up"))
    return out


def proof_end(leaf: Column, proof: Column) -> Column:
    """The digest that a proof leads to from a leaf."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.when(s["direction"] == "left", F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256))


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    return proof_end(leaf, proof) == root


def build_chain(blocks: DataFrame, chain: str, height: str, root: str) -> DataFrame:
    """Block hashes of each chain: every hash covers the previous one.

    The order is inherent, so one chain is folded in one task; key chains by period to keep them
    short (a block stands for a whole batch of records).
    """
    lists = blocks.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct(F.col(height).alias("h"), F.col(root).alias("r")))).alias("l"))
    folded = F.expr("""aggregate(l, array('0000000000000000000000000000000000000000000000000000000000000000'),
        (acc, b) -> concat(acc, array(sha2(concat_ws(':', CAST(b.h AS STRING), element_at(acc, -1), b.r), 256))))""")
    return lists.withColumn("hs", folded).select(chain, F.posexplode("l").alias("i", "b"), "hs").select(
        chain, F.col("b.h").alias(height), F.col("b.r").alias(root), F.col("hs")[F.col("i")].alias("previous_hash"), F.col("hs")[F.col("i") + 1].alias("block_hash"))


def validate_chain(blocks: DataFrame, chain: str, height: str, root: str) -> DataFrame:
    """First break per chain: wrong own hash or wrong link; null when the chain is sound."""
    rows = H.with_previous(blocks, [chain], ["block_hash"], time=height, tie=height)
    own = F.sha2(F.concat_ws(":", F.col(height).cast("string"), "previous_hash", root), 256) != F.col("block_hash")
    link = F.col("prev_block_hash").isNotNull() & (F.col("prev_block_hash") != F.col("previous_hash"))
    return rows.groupBy(chain).agg(F.count(F.lit(1)).alias("blocks"), F.min(F.when(own | link, F.col(height))).alias("first_break"))


def integrity_faults(df: DataFrame, batch: str, digest: str, time: str = "ts_us", tie: str = "event_id", key: str | None = None,
                     fields: Sequence[str] = signing.CONTENT_FIELDS) -> DataFrame:
    """Faults per batch: duration outliers, repeated content, impossible metrics, disorder in arrival (``tie``) order.

    With the signing ``key`` also content that does not match its ``content_hash`` and signatures that do not match that hash,
    each counted by itself; a record without hash or signature is not held against either.
    """
    stats = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.avg("duration").alias("_m"), F.stddev_pop("duration").alias("_s"))
    dup = df.groupBy(batch, digest).agg((F.count(F.lit(1)) - 1).alias("_d")).groupBy(batch).agg(F.sum("_d").alias("duplicate_hash"))
    rows = H.with_previous(df, [batch], [time], time=tie, tie=tie).join(stats, batch)
    out = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if((F.col("_n") > 3) & (F.col("_s") > 0) & (F.abs(F.col("duration") - F.col("_m")) > 3 * F.col("_s"))).alias("duration_outlier"),
        F.count_if((F.col("duration") > 0.1) & (F.col("cpu_utilization") == 0)).alias("impossible_cpu"),
        F.count_if((F.col("memory_spike_kb") > 1_000_000) & (F.col("duration") < 0.001)).alias("impossible_memory"),
        F.count_if(F.col(time) < F.col(f"prev_{time}") - 60_000_000).alias("_late"),
        *([] if key is None else [F.count_if(c).alias(n) for n, c in signing.broken(key, fields).items()]))
    out = out.join(dup, batch).withColumn("disorder", (F.col("_late") > F.col("records") * 0.1).cast("int"))
    return out.withColumn("faults", F.expr(
        "duration_outlier + duplicate_hash + impossible_cpu + impossible_memory + disorder" + ("" if key is None else " + hash_mismatch + bad_signature"))).drop("_late")
