"""The forest of a record's own history: one model a slice of a key's timeline, each record judged by the last model before it.

A key's timeline is cut at ``least - 1`` rows, then at twice as many each time, and from ``step`` rows on at every multiple of
``step``. The model at a cut is fitted on the ``limit`` rows before it and judges the rows up to the next cut. A record travels
once to be judged and about ``limit / step`` times as history, so a group holds at most ``limit + step`` narrow rows however
hot its key is, and a lost task is simply run again: the trees of a group follow from its key, its cut and the seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators import history as H
from faultline.operators.detectors.registry import detect

METRICS = ("duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes")
OUT = "outlier boolean, detected boolean, confidence double, anomaly_type string, decision double, model_rows long"


def path_norm(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


class Forest:
    """Isolation trees as heaps, all grown side by side one level at a time."""

    def __init__(self, x: np.ndarray, trees: int, rows: int, rng: np.random.Generator):
        size = min(rows, len(x))
        self.norm, self.levels = float(path_norm(size)), max(1, int(np.ceil(np.log2(max(size, 2)))))
        picked = np.argpartition(rng.random((trees, len(x))), size - 1, axis=1)[:, :size].ravel()
        data, tree = x[picked], np.repeat(np.arange(trees), size)
        node = np.zeros(len(data), dtype=np.int64)
        width = 2 ** (self.levels + 1) - 1
        self.feature = np.full((trees, width), -1, dtype=np.int8)
        self.cut, self.depth = np.zeros((trees, width)), np.zeros((trees, width))
        for level in range(self.levels + 1):
            order = np.argsort(tree * width + node, kind="stable")
            data, tree, node = data[order], tree[order], node[order]
            starts = np.flatnonzero(np.diff(tree * width + node, prepend=-1))
            if not len(starts):
                return
            t, n, held = tree[starts], node[starts], np.diff(starts, append=len(node))
            low, high = np.minimum.reduceat(data, starts, axis=0), np.maximum.reduceat(data, starts, axis=0)
            draw = np.where(high > low, rng.random(low.shape), -1.0)
            f = draw.argmax(axis=1)
            at = (np.arange(len(f)), f)
            split = (draw[at] >= 0) & (level < self.levels)
            self.depth[t, n] = level + path_norm(held)
            cut = low[at] + rng.random(len(f)) * (high[at] - low[at])
            self.feature[t[split], n[split]], self.cut[t[split], n[split]] = f[split], cut[split]
            for child in (1, 2):
                self.depth[t[split], 2 * n[split] + child] = level + 1  # of a child that no row reaches
            of = np.repeat(np.arange(len(starts)), held)
            right = data[np.arange(len(data)), f[of]] >= cut[of]
            go = split[of]
            data, tree, node = data[go], tree[go], (2 * node + 1 + right)[go]

    def score(self, x: np.ndarray) -> np.ndarray:
        """From -1 (outlier) to 0, as the mean path over all trees says."""
        trees = np.arange(len(self.cut))[None, :]
        node, row = np.zeros((len(x), len(self.cut)), dtype=np.int64), np.arange(len(x))[:, None]
        for _ in range(self.levels):
            f = self.feature[trees, node]
            node = np.where(f >= 0, 2 * node + 1 + (x[row, np.maximum(f, 0)] >= self.cut[trees, node]), node)
        return -np.power(2.0, -self.depth[trees, node].mean(axis=1) / max(self.norm, 1e-12))


def _cuts(rn: Column, least: int, step: int) -> Column:
    """The last cut before a row; null for the rows before the first."""
    first, before = least - 1, rn - 1
    doubled = F.lit(None).cast("long")
    n = first
    while n < step:
        doubled = F.when(before >= n, F.lit(n).cast("long")).otherwise(doubled)
        n *= 2
    return F.when(before >= step, before - F.pmod(before, F.lit(step))).otherwise(doubled)


def history_forest(df: DataFrame, keys: Sequence[str] = ("function_id",), cols: Sequence[str] = METRICS, id_col: str = "event_id", gate: float = 0.6,
                   contamination: float = 0.1, trees: int = 100, rows_per_tree: int = 256, least: int = 50, limit: int = H.HISTORY, step: int = 5_000,
                   seed: int = 42, block: int = H.BLOCK) -> DataFrame:
    """Verdict of each record: id, outlier, detected, confidence, anomaly_type, decision, model_rows.

    ``decision`` is the score above the training rows' ``contamination`` quantile, negative for outliers; confidence is its
    size, and an outlier is detected where that passes ``gate``. With fewer than ``least`` records of history the z-score
    detector decides (decision null, model_rows 0). A null metric counts as 0. Repeated ids are judged each by themselves.
    """
    if not 2 <= least - 1 <= step <= limit:
        raise ValueError("needs least - 1 <= step <= limit")
    numbered = H.index_rows(df, keys, tie=id_col)
    rows = numbered.select(*keys, F.col(id_col).alias("_id"), "rn", "key_rows", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    first, fixed = least - 1, []
    while first < step:
        fixed.append(first)
        first *= 2
    later = F.expr(f"sequence(greatest({step}, (rn + {step} - 1) DIV {step} * {step}), greatest({step}, (rn + {step} - 1) DIV {step} * {step}, rn + {limit} - 1), {step})")
    ahead = F.filter(F.concat(F.array(*[F.lit(n).cast("long") for n in fixed]), later.cast("array<long>")),
                     lambda c: (c >= F.col("rn")) & (c < F.col("rn") + limit) & (c < F.col("key_rows")))
    past = rows.withColumn("at", F.explode(ahead)).withColumn("past", F.lit(True))
    both = rows.withColumn("at", _cuts(F.col("rn"), least, step)).where("at IS NOT NULL").withColumn("past", F.lit(False)).unionByName(past)
    xs, names = [f"x{i}" for i in range(len(cols))], list(keys)
    id_type = dict(rows.dtypes)["_id"]

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable")
        old, new = pdf[pdf["past"]][xs].to_numpy(dtype=float), pdf[~pdf["past"]]
        rng = np.random.default_rng([seed, zlib.crc32(repr(tuple(str(k) for k in key)).encode())])
        forest = Forest(old, trees, rows_per_tree, rng)
        offset = np.quantile(forest.score(old), contamination)
        decision = forest.score(new[xs].to_numpy(dtype=float)) - offset
        sure, outlier = np.abs(decision), decision < 0
        found = outlier & (sure > gate)
        return pd.DataFrame({"_id": new["_id"].to_numpy(), "outlier": outlier, "detected": found, "confidence": sure,
                             "anomaly_type": np.where(found, "execution_failure", "benign"), "decision": decision, "model_rows": np.full(len(new), len(old))})

    scored = both.drop("key_rows").groupBy(*names, "at").applyInPandas(judge, f"_id {id_type}, {OUT}")
    early = detect(numbered.where(F.col("rn") < least).drop("rn", "key_rows"), ["statistical_outlier"], keys, limit, block)  # all their history is among them
    z = lambda f: F.col(f"statistical_outlier.{f}")
    young = early.select(F.col(id_col).alias("_id"), z("detected").alias("outlier"), z("detected").alias("detected"), z("confidence").alias("confidence"),
                         z("anomaly_type").alias("anomaly_type"), F.lit(None).cast("double").alias("decision"), F.lit(0).cast("long").alias("model_rows"))
    return scored.unionByName(young).withColumnRenamed("_id", id_col)
