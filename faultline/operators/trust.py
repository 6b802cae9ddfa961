"""Clipped running sums at scale.

``x -> clip(x + d)`` steps compose: any run of them is again ``x -> min(b, max(a, x + c))``. So a
key's steps are folded per block of rows, blocks per super-block, and starting values are handed
back down. No task sees more than one block of a key, however large the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from faultline.operators.history import index_rows

_FOLD = """aggregate({0}, named_struct('c', 0D, 'a', -1e300D, 'b', 1e300D), (s, m) -> named_struct(
    'c', s.c + m.c, 'a', least(m.b, greatest(m.a, s.a + m.c)), 'b', least(m.b, greatest(m.a, s.b + m.c))))"""
_SCAN = "aggregate({0}, array({1}), (acc, m) -> concat(acc, array(least(m.b, greatest(m.a, element_at(acc, -1) + m.c)))))"


def clipped_running_sum(df: DataFrame, keys: Sequence[str], time: str, tie: str, delta: str, start: float,
                        lo: float, hi: float, block: int = 1000) -> DataFrame:
    """(keys, tie, running, position): the value after each row in (time, tie) order."""
    keys = list(keys)
    step = F.struct("rn", F.col(delta).alias("c"), F.lit(lo).alias("a"), F.lit(hi).alias("b"), F.col(tie).alias("id"))
    rows = index_rows(df, keys, time, tie).select(
        *keys, F.expr(f"(rn - 1) DIV {block}").alias("b1"), F.expr(f"(rn - 1) DIV {block * block}").alias("b2"), step.alias("m"))
    lists = rows.groupBy(*keys, "b2", "b1").agg(F.array_sort(F.collect_list("m")).alias("l1"))
    small = lists.select(*keys, "b2", "b1", F.expr(_FOLD.format("l1")).alias("f"))
    part = F.array_sort(F.collect_list(F.struct(F.col("b1").alias("o"), F.col("f.c").alias("c"), F.col("f.a").alias("a"), F.col("f.b").alias("b"))))
    mid = small.groupBy(*keys, "b2").agg(part.alias("l2")).withColumn("f", F.expr(_FOLD.format("l2")))
    top = mid.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col("b2").alias("o"), F.col("f.c").alias("c"), F.col("f.a").alias("a"), F.col("f.b").alias("b")))).alias("l3"))
    top = top.withColumn("s3", F.expr(_SCAN.format("l3", f"CAST({start} AS DOUBLE)"))).select(*keys, F.posexplode(F.slice("s3", 1, F.size("l3"))).alias("i", "x0"), "l3")
    start2 = top.select(*keys, F.col("l3")[F.col("i")]["o"].alias("b2"), "x0")
    mid = mid.join(start2, [*keys, "b2"]).withColumn("s2", F.expr(_SCAN.format("l2", "x0")))
    start1 = mid.select(*keys, "b2", "l2", F.posexplode(F.slice("s2", 1, F.size("l2"))).alias("i", "x1")).select(
        *keys, "b2", F.col("l2")[F.col("i")]["o"].alias("b1"), "x1")
    done = lists.join(start1, [*keys, "b2", "b1"]).withColumn("s1", F.expr(_SCAN.format("l1", "x1")))
    return done.select(*keys, "l1", F.posexplode(F.slice("s1", 2, F.size("l1"))).alias("i", "running")).select(
        *keys, F.col("l1")[F.col("i")]["id"].alias(tie), "running", F.col("l1")[F.col("i")]["rn"].alias("position"))
