"""Exact percentiles per key that survive a key holding a third of the rows.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a mergeable
sketch first bounds where each percentile can lie; only the values inside those narrow bands are
then ordered, and rows below a band are merely counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000,
                    pick_index: bool = False) -> DataFrame:
    """(keys, p, q): linearly interpolated percentiles, as ``percentile`` gives them.

    With ``pick_index`` the element at index floor(n * p) of the sorted values instead. Groups of
    up to ``accuracy`` rows are ordered whole; beyond that the sketch's error bound holds.
    """
    keys = list(keys)
    slack = 3.0 / accuracy
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lows, accuracy).alias("_lo"),
        F.percentile_approx("_v", highs, accuracy).alias("_hi"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    bands = sketch.select(*keys, "_n", F.array(*[
        F.struct(F.lit(float(p)).alias("p"),
                 (F.floor(F.lit(float(p)) * F.col("_n")).cast("double") if pick_index else F.lit(float(p)) * (F.col("_n") - 1)).alias("at"),
                 F.when((F.col("_n") <= accuracy) | F.lit(lows[i] <= 0), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"),
                 F.when((F.col("_n") <= accuracy) | F.lit(highs[i] >= 1), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"))
        for i, p in enumerate(probs)]).alias("_bands"))
    values = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    joined = values.join(bands, keys) if keys else values.crossJoin(F.broadcast(bands))
    spread = joined.select(*keys, "_v", "_c", F.explode("_bands").alias("b"))
    inside = (F.col("_v") >= F.col("b.lo")) & (F.col("_v") <= F.col("b.hi"))
    # values below the band collapse into one row per key and percentile before anything is sorted
    slim = spread.where(F.col("_v") <= F.col("b.hi")).groupBy(
        *keys, F.col("b.p").alias("p"), F.col("b.at").alias("at"), F.when(inside, F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c"))
    w = W.partitionBy(*keys, "p").orderBy(F.asc_nulls_first("_v"))
    ranked = slim.withColumn("_upto", F.sum("_c").over(w))
    first, last = F.floor("at") + 1, F.ceil("at") + 1
    hit = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    out = ranked.groupBy(*keys, "p", "at").agg(hit(first).alias("_a"), hit(last).alias("_b"), F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_upto"))), F.lit(0)).alias("_below"), F.max("_upto").alias("_reach"))
    # the band holds the rank by the sketch's bound; a rank outside must not become a silent wrong number
    missed = (F.col("_below") >= first) | (F.col("_reach") < F.least(last, first))
    out = out.withColumn("_a", F.when(missed, F.raise_error(F.lit("a percentile lies outside its band")).cast("double")).otherwise(F.col("_a")))
    return out.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("at") - F.floor("at"))).alias("q"))
