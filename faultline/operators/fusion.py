"""Weighted fusion of detector verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.detectors import DETECTORS

# --- fixed values: fusion weight of a detector; any other detector weighs 0.01 ---
FUSION_WEIGHTS = {
    "statistical_outlier": 0.15,
    "isolation_forest": 0.12,
    "temporal_deviation": 0.10,
    "resource_spike": 0.08,
    "execution_pattern": 0.08,
    "network_anomaly": 0.07,
    "memory_leak": 0.06,
    "cpu_burst": 0.06,
    "io_intensive": 0.05,
    "cold_start": 0.05,
    "timeout_pattern": 0.04,
    "frequency_anomaly": 0.04,
    "duration_outlier": 0.03,
    "correlation_break": 0.03,
    "seasonal_deviation": 0.02,
    "trend_change": 0.02,
}
# --- fixed values: trust of a detector by its accuracy; medium below ten judged results ---
TRUST = {"high": 1.0, "medium": 0.7, "low": 0.4, "untrusted": 0.1}


def normalise_weights(weights: dict[str, float]) -> dict[str, float]:
    """Clamp to [0, 1] and scale to sum 1; equal weights when all are zero."""
    held = {k: min(1.0, max(0.0, v)) for k, v in weights.items()}
    total = sum(held.values())
    return {k: (v / total if total > 0 else 1.0 / len(held)) for k, v in held.items()}


def detector_trust(feedback: DataFrame, name: str = "detector", correct: str = "correct") -> DataFrame:
    """Trust per detector from a log of judged results."""
    acc = F.col("accurate") / F.col("total")
    return feedback.groupBy(name).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col(correct).cast("bigint")).alias("accurate")
    ).withColumn(
        "trust",
        F.when(F.col("total") < 10, TRUST["medium"]).when(acc >= 0.9, TRUST["high"])
        .when(acc >= 0.7, TRUST["medium"]).when(acc >= 0.5, TRUST["low"]).otherwise(TRUST["untrusted"]),
    )


def _sum(values: list[Column]) -> Column:
    total = F.lit(0.0)
    for v in values:
        total = total + v
    return total


def fuse(verdicts: DataFrame, names: list[str] | None = None, weights: dict[str, float] | None = None,
         trust: dict[str, float] | None = None) -> DataFrame:
    """Fuse the detector columns of ``detect`` into one verdict per record.

    A narrow projection: the detectors are columns, so nothing is shuffled or exploded.
    """
    names = sorted(names or [c for c in verdicts.columns if c in DETECTORS])
    weights, trust = weights or FUSION_WEIGHTS, trust or {}
    w = {n: min(1.0, max(0.0, weights.get(n, 0.01))) * min(1.0, max(0.0, trust.get(n, TRUST["medium"]))) for n in names}
    total = sum(w.values())
    hit = {n: F.col(f"{n}.detected").cast("double") * F.lit(w[n]) for n in names}
    kinds = sorted({*_kinds()})
    ballots = [
        F.struct(
            F.round(_sum([F.when(F.col(f"{n}.anomaly_type") == k, hit[n]).otherwise(0.0) for n in names]), 9).alias("votes"),
            # equal votes: the type the first detector in name order voted for
            (-F.coalesce(*[F.when((F.col(f"{n}.anomaly_type") == k) & F.col(f"{n}.detected"), i) for i, n in enumerate(names)],
                         F.lit(len(names)))).alias("first"),
            F.lit(k).alias("kind"))
        for k in kinds
    ]
    need = max(2, min(3, len(names) // 2))
    out = verdicts.withColumns({
        "fusion_votes": _sum([F.col(f"{n}.detected").cast("int") for n in names]).cast("int"),
        "fusion_score": _sum(list(hit.values())) / F.lit(total),
        "fusion_confidence": _sum([hit[n] * F.col(f"{n}.confidence") for n in names]) / F.lit(total),
        "fusion_severity": _sum([hit[n] * F.col(f"{n}.severity") for n in names]) / F.lit(total),
        "_top": F.array_max(F.array(*ballots)),
    })
    return out.withColumns({
        "consensus": F.col("fusion_votes") / F.lit(float(len(names))),
        "primary_type": F.when(F.col("fusion_votes") > 0, F.col("_top.kind")).otherwise("benign"),
        # twelve places: a tie must not hang on the order of summation
        "fused_anomaly": (F.round("fusion_score", 12) > 0.5) & (F.round("fusion_confidence", 12) > 0.6)
        & (F.col("fusion_votes") >= need),
        "decision_confidence": F.least("fusion_score", "fusion_confidence", F.col("fusion_votes") / F.lit(float(need))),
    }).drop("_top")


def _kinds() -> tuple[str, ...]:
    """Types the detectors can vote for."""
    return ("billing_abuse", "cold_start", "cpu_burst", "execution_failure", "io_intensive", "memory_spike",
            "network_anomaly", "starvation_fallback", "timeout_fallback")


def explain(fused: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Text that names the three most confident detectors behind a verdict."""
    names = sorted(names or [c for c in fused.columns if c in DETECTORS])
    found = F.filter(F.array(*[F.struct(
        (-F.col(f"{n}.confidence")).alias("order"), F.lit(n).alias("name"), F.col(f"{n}.detected").alias("on")) for n in names]),
        lambda d: d["on"])
    top = F.transform(F.slice(F.array_sort(found), 1, 3), lambda d: d["name"])
    all_n = F.lit(len(names))
    # --- fixed values: the explanation texts ---
    text = F.when(
        F.col("fused_anomaly"),
        F.format_string("Anomaly detected: %s. Consensus: %.1f%% (%d/%d algorithms). Top contributors: %s",
                        "primary_type", F.col("consensus") * 100, "fusion_votes", all_n, F.concat_ws(", ", top)),
    ).otherwise(F.format_string("No anomaly detected. %d/%d algorithms detected issues (consensus: %.1f%%)",
                                "fusion_votes", all_n, F.col("consensus") * 100))
    return fused.withColumns({"top_detectors": F.concat_ws(", ", top), "explanation": text})


def detection_stats(long: DataFrame) -> DataFrame:
    """Totals, rate and mean confidence per detector from ``detect_long`` rows."""
    return long.groupBy("name").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("detected").cast("bigint")).alias("detections"),
        F.avg(F.col("detected").cast("double")).alias("rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.max("confidence").alias("max_confidence"),
    )



def _normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    a = F.abs(x) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * a)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-a * a)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def confidence_interval(fused: DataFrame, names: list[str] | None = None, weights: dict[str, float] | None = None,
                        trust: dict[str, float] | None = None, z: float = 1.96) -> DataFrame:
    """Bootstrap confidence of a fused verdict, in closed form.

    One resample draws n detectors with replacement and adds up their weighted scores y. The sum
    has mean n * avg(y) and variance n * var(y) exactly, so the limit of endlessly many resamples
    needs no random draws. The p-value is the share of resamples at most 0.5.
    """
    names = sorted(names or [c for c in fused.columns if c in DETECTORS])
    weights, trust = weights or FUSION_WEIGHTS, trust or {}
    w = {d: weights.get(d, 0.01) * trust.get(d, TRUST["medium"]) for d in names}
    n, total = float(len(names)), sum(w.values())
    y = [F.col(f"{d}.detected").cast("double") * F.col(f"{d}.confidence") * F.lit(w[d] / total) for d in names]
    out = fused.withColumns({"_s": _sum(y), "_q": _sum([v * v for v in y])})
    out = out.withColumns({"bootstrap_mean": F.col("_s"), "bootstrap_variance": F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / n)})
    out = out.withColumn("_sd", F.sqrt("bootstrap_variance"))
    out = out.withColumns({
        "ci95_low": F.greatest(F.lit(0.0), F.col("_s") - z * F.col("_sd")), "ci95_high": F.col("_s") + z * F.col("_sd"),
        "p_value": F.when(F.col("_sd") > 0, _normal_cdf((0.5 - F.col("_s")) / F.nullif("_sd", F.lit(0.0)))).otherwise((F.col("_s") <= 0.5).cast("double"))})
    return out.withColumns({
        "model_uncertainty": F.col("bootstrap_variance"), "data_uncertainty": F.abs(F.col("fusion_confidence") - F.col("fusion_score")),
        "epistemic_uncertainty": (F.col("ci95_high") - F.col("ci95_low")) / 2, "aleatoric_uncertainty": F.lit(min(0.1, 1 / n)),
    }).drop("_s", "_q", "_sd")
