"""One-class SVM with a radial kernel: random Fourier features and a conditional-gradient solver over grouped sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from faultline.operators.models import moments, scaled
from faultline.operators.quantiles import exact_quantiles
from faultline.session import stored


def one_class_svm(train: DataFrame, test: DataFrame, cols: Sequence[str], nu: float = 0.1, gamma: float | None = None, features: int = 128, tolerance: float = 0.02, rounds: int = 200, seed: int = 42) -> DataFrame:
    """``test`` with ``decision`` (negative outside), score (0 to 1 over ``test``) and threshold, the score of decision 0.

    The dual of the problem is the shortest mean of feature vectors in which no row weighs more than 1 / (nu n). Each round moves
    towards the mean of the rows with the lowest nu share of decisions, by an exact line search, until the duality gap is at most
    ``tolerance`` of the squared length; not getting there in ``rounds`` is an error. The offset is the exact quantile. What comes
    to the driver is ``features`` sums a round. ``gamma`` is 1 / columns unless given, as the columns are standardised. Rows with a
    null in any column do not train and have a null decision. Raises on an empty ``train``.
    """
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in cols)
    fit, d = moments(train.where(known), cols), len(cols)
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, np.sqrt(2 * (gamma or 1 / d)), (d, features))
    shift = rng.uniform(0, 2 * np.pi, features)
    rows = stored(scaled(train.where(known), cols, fit).select(*[F.col("x")[i].alias(f"x{i}") for i in range(d)]))

    def lift(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / features) * np.cos(x @ omega + shift)

    def decision(w: np.ndarray, x: list[Column]) -> Column:
        @F.pandas_udf(T.DoubleType())
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(lift(np.column_stack([p.to_numpy(dtype=float) for p in part])) @ w)
        return score(*x)

    def mean_below(w: np.ndarray | None, cut: float) -> np.ndarray:
        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(features), 0
            for part in parts:
                f = lift(part.to_numpy(dtype=float))
                f = f if w is None else f[f @ w <= cut]
                total, n = total + f.sum(axis=0), n + len(f)
            yield pd.DataFrame({"j": range(-1, features), "v": [float(n), *total]})
        got = {r["j"]: r["v"] for r in rows.mapInPandas(sums, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
        if not got.get(-1):
            raise ValueError("no rows to train on")
        return np.array([got[j] for j in range(features)]) / got[-1]

    w = mean_below(None, 0.0)
    x = [F.col(f"x{i}") for i in range(d)]
    for _ in range(rounds):
        cut = rows.select(decision(w, x).alias("s")).agg(F.percentile_approx("s", nu, 10_000)).first()[0]
        step = w - mean_below(w, cut)
        if w @ step <= tolerance * (w @ w):
            break
        w = w - min(1.0, (w @ step) / (step @ step)) * step
    else:
        raise ArithmeticError(f"the duality gap is still above {tolerance} after {rounds} rounds")
    rho = exact_quantiles(rows.select(F.lit(1).alias("g"), decision(w, x).alias("s")), ["g"], "s", [nu]).first()["q"]
    out = scaled(test, cols, fit).withColumn("decision", F.when(F.expr(known), decision(w, [F.col("x")[i] for i in range(d)]) - rho)).drop("x")
    out = stored(out)
    ends = out.agg(F.min("decision").alias("_lo"), F.max("decision").alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return out.crossJoin(F.broadcast(ends)).withColumns({  # one row
        "score": F.when(F.col("decision").isNotNull(), F.coalesce((F.col("_hi") - F.col("decision")) / span, F.lit(0.0))), "threshold": F.coalesce(F.col("_hi") / span, F.lit(0.0))}).drop("_lo", "_hi")
