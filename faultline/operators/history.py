"""Per-key history without ever holding one key in one task.

A record's history is the last ``limit`` records of its key, itself included. One key may own
a third of the data, so a key's timeline is cut into blocks of ``block`` consecutive rows and
each block also receives the ``limit - 1`` rows before it (its *halo*). Every window below is
partitioned by (key, block): a task sorts at most ``block + limit`` rows of a key, and frames
still see the whole history. Frames over thousands of rows are differences of running sums,
never re-scanned frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HISTORY = 10_000
BLOCK = 40_000
SLOT_US = 60_000_000


def index_rows(df: DataFrame, keys: Sequence[str], time: str = "ts_us", tie: str = "event_id",
               slot: int = SLOT_US) -> DataFrame:
    """Add ``rn``, the 1-based position of a row in its key, and ``key_rows``, the key's size.

    Rows are counted per (key, time slot) with map-side combining; the running total of those
    few counts is the offset of each slot. Only one slot of one key is ever sorted in a task.
    """
    keys = list(keys)
    slotted = df.withColumn("_slot", F.expr(f"{time} DIV {slot}"))
    counts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_slot")
    offsets = counts.select(
        *keys, "_slot",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("key_rows"),
    )
    in_slot = W.partitionBy(*keys, "_slot").orderBy(time, tie)
    return (
        slotted.join(offsets, [*keys, "_slot"])
        .withColumn("rn", F.col("_offset") + F.row_number().over(in_slot))
        .drop("_slot", "_offset")
    )


def running_total(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], time: str = "ts_us", tie: str = "event_id", slot: int = SLOT_US) -> DataFrame:
    """Running sums over the whole life of a key, by the same slots: offsets of earlier slots plus a sum within one."""
    keys = list(keys)
    slotted = df.withColumn("_slot", F.expr(f"{time} DIV {slot}")).withColumns({f"_v_{n}": c for n, c in columns.items()})
    sums = slotted.groupBy(*keys, "_slot").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in columns])
    upto = W.partitionBy(*keys).orderBy("_slot")
    offsets = sums.select(*keys, "_slot", *[(F.sum(f"_s_{n}").over(upto) - F.col(f"_s_{n}")).alias(f"_o_{n}") for n in columns])
    w = W.partitionBy(*keys, "_slot").orderBy(time, tie).rowsBetween(W.unboundedPreceding, 0)
    out = slotted.join(offsets, [*keys, "_slot"]).withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(w) for n in columns})
    return out.drop("_slot", *[f"_v_{n}" for n in columns], *[f"_o_{n}" for n in columns])


def blocks(df: DataFrame, limit: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Assign ``blk`` and copy each row into the later blocks whose history reaches it (``halo``)."""
    if block < limit:
        raise ValueError("block must be at least the history limit")
    own = F.expr(f"(rn - 1) DIV {block}")
    last_used = F.least(F.expr(f"(rn + {limit} - 2) DIV {block}"), F.expr(f"(key_rows - 1) DIV {block}"))
    return (
        df.withColumn("_own", own)
        .withColumn("blk", F.explode(F.sequence("_own", F.greatest("_own", last_used))))
        .withColumn("halo", F.col("blk") != F.col("_own"))
        .drop("_own")
    )


def blocked(df: DataFrame, keys: Sequence[str], limit: int = HISTORY, block: int = BLOCK,
            time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    return blocks(index_rows(df, keys, time, tie), limit, block)


def one_block_a_task(rows: DataFrame, df: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """The blocks ``df`` of ``rows``, each in a task of its own (column ``_task``), however few bytes they have: their windows hold far more than what is shuffled.

    Tasks are numbered, not hashed: two blocks that a hash brings together hold twice the memory and spill. Only keys of less than a
    sixteenth of a block are hashed, over tasks of about half a block. The numbered keys are at most 16 for each block of rows.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = F.col("_rows") >= block / 16
    tasks = F.ceil(F.col("_rows") / block)
    total = sizes.agg(F.sum(F.when(large, tasks)).alias("own"), F.ceil(F.sum(F.when(~large, F.col("_rows"))) * 2 / block).alias("shared"), F.count_if(~large).alias("small")).first()  # three numbers
    own, shared = int(total["own"] or 0), max(int(total["shared"] or 1), min(total["small"], df.sparkSession.sparkContext.defaultParallelism))
    first = sizes.where(large).select(*keys, (F.sum(tasks).over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)) - tasks).alias("_first"))
    hashed = own + F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(shared))
    placed = df.join(F.broadcast(first), list(keys), "left").withColumn("_task", F.coalesce(F.col("_first") + F.col("blk"), hashed).cast("int")).drop("_first")
    return placed.repartitionById(own + shared, "_task")


def by_block(keys: Sequence[str], *more: str):
    return W.partitionBy(*keys, "blk", *more)


def _packed(df: DataFrame, here: Column, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Columns beyond ``keep`` as one struct ``_row`` that is null outside ``here``: copies of a row that only offer a value stay narrow."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.when(here, F.struct(*[F.col(c) for c in rest])).alias("_row")), rest


def look_back(df: DataFrame, part: Sequence[str], position: str, payload: str,
              shifts: dict[str, int], upto: Column | None = None, fields: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """For each named shift, the ``payload`` of the latest row at ``position <= here - shift``.

    Every row is repeated at ``position + shift``, so the answer is the last repeated row before
    this one: a sort instead of a range join. ``upto`` bounds which repeats can still be read. With
    ``fields`` a shift finds only those fields of the payload.
    """
    names = list(shifts)
    of = {n: list(fields[n]) if fields else df.select(f"{payload}.*").columns for n in names}
    here = F.struct(F.lit(-1).alias("k"), F.col(position).alias("p"))
    moved = [
        F.struct(F.lit(i).alias("k"), (F.col(position) + F.lit(shifts[n])).alias("p"))
        for i, n in enumerate(names)
    ]
    copies = F.array(here, *moved)
    if upto is not None:
        copies = F.filter(copies, lambda c: (c["k"] < 0) | (c["p"] <= upto))
    some = sorted({f for n in names for f in of[n]})
    offer = F.when(F.col("_c.k") >= 0, F.struct(*[F.col(f"{payload}.{f}").alias(f) for f in some]))
    keep = list(dict.fromkeys([*part, position, "rn"]))
    columns = df.columns
    spread = df.withColumn("_c", F.explode(copies)).withColumn("_offer", offer)
    spread, rest = _packed(spread, F.col("_c.k") < 0, [*keep, "_c", "_offer"])
    w = (
        W.partitionBy(*part)
        .orderBy(F.col("_c.p"), F.col("_c.k") < 0, F.col(position), F.col("rn"))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    found = [
        F.last(F.when(F.col("_c.k") == i, F.struct(*[F.col(f"_offer.{f}").alias(f) for f in of[n]])), ignorenulls=True).over(w).alias(n)
        for i, n in enumerate(names)
    ]
    out = spread.select(*keep, "_c", "_row", *found).where(F.col("_c.k") < 0)
    return out.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in columns], *names)


def rolling_quantiles(limit: int):
    """Exact percentiles of the last ``limit`` values, for rows sorted by (group, rn) in a partition.

    Spark has no incremental order statistics, so a sorted list per block is kept in an Arrow
    iterator UDF. Only the four argument columns travel to Python. It is declared
    non-deterministic so that no filter is moved below it (halo rows must be seen).
    """
    @F.pandas_udf("struct<p1 double, p5 double, p50 double, p95 double, p99 double, net95 double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_left, insort
        from collections import deque

        group, last = None, 0
        ordered: tuple[list, list] = ([], [])
        arrived: tuple[deque, deque] = (deque(), deque())

        def at(values: list, q: float) -> float:
            pos = q * (len(values) - 1)
            lo = int(pos)
            if lo + 1 >= len(values):
                return values[lo]
            return values[lo] + (values[lo + 1] - values[lo]) * (pos - lo)

        for groups, rns, durs, nets in parts:
            out = []
            for g, rn, d, n in zip(groups.tolist(), rns.tolist(), durs.tolist(), nets.tolist()):
                if g != group:
                    group, last = g, 0
                    ordered, arrived = ([], []), (deque(), deque())
                if rn <= last:
                    raise ValueError("rows of a block are not in order")
                last = rn
                for keep, queue, v in ((ordered[0], arrived[0], d), (ordered[1], arrived[1], n)):
                    insort(keep, v)
                    queue.append(v)
                    if len(queue) > limit:
                        del keep[bisect_left(keep, queue.popleft())]
                a = ordered[0]
                out.append((at(a, 0.01), at(a, 0.05), at(a, 0.5), at(a, 0.95), at(a, 0.99), at(ordered[1], 0.95)))
            yield pd.DataFrame(out, columns=["p1", "p5", "p50", "p95", "p99", "net95"])

    return run.asNondeterministic()


def look_at(df: DataFrame, part: Sequence[str], name: str, index: Column, offered: Column, payload: str, fields: Sequence[str] | None = None) -> DataFrame:
    """The ``payload``, or only these ``fields`` of it, of the row whose ``rn`` equals ``index`` in the same group.

    Rows for which ``offered`` holds appear once more as providers; provider and readers meet in
    a window partitioned by the wanted position. A null ``index`` finds nothing.
    """
    reader = F.struct(F.lit(False).alias("gives"), F.coalesce(index, -F.col("rn")).alias("at"))
    giver = F.when(offered, F.struct(F.lit(True).alias("gives"), F.col("rn").alias("at")))
    value = F.struct(*[F.col(f"{payload}.{f}").alias(f) for f in fields]) if fields else F.col(payload)
    both = df.withColumn("_r", F.explode(F.array_compact(F.array(reader, giver)))).withColumns({"_at": F.col("_r.at"), "_offer": F.when(F.col("_r.gives"), value)})
    columns = [c for c in df.columns if c != name]
    both, rest = _packed(both, ~F.col("_r.gives"), [*part, "_at", "_r", "_offer"])
    w = W.partitionBy(*part, "_at")
    out = both.withColumn(name, F.max("_offer").over(w)).where(~F.col("_r.gives"))
    return out.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in columns], name)


def with_previous(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lags: Sequence[int] = (1,), time: str = "ts_us",
                  tie: str = "event_id", block: int = BLOCK) -> DataFrame:
    """Add ``prev_<column>`` (or ``prev<k>_<column>``) in (time, tie) order of the key, and ``rn`` and ``key_rows``."""
    reach = max(lags) + 1
    out = blocked(df, keys, reach, max(block, reach), time, tie)
    w = W.partitionBy(*keys, "blk").orderBy("rn")
    out = out.withColumns({f"prev_{c}" if k == 1 else f"prev{k}_{c}": F.lag(c, k).over(w) for k in lags for c in columns})
    return out.where(~F.col("halo")).drop("blk", "halo")


def with_next(df: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Add ``next_<column>``: time is mirrored, so the previous row is the next one."""
    mirrored = df.withColumns({"_time": -F.col(time), "_tie": F.xxhash64(tie) if dict(df.dtypes)[tie] == "string" else -F.col(tie)})
    out = with_previous(mirrored, keys, columns, time="_time", tie="_tie")
    return out.withColumnsRenamed({f"prev_{c}": f"next_{c}" for c in columns}).drop("_time", "_tie", "rn", "key_rows")
