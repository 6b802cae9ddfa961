"""Evaluation of scores against labels: counts, curves, thresholds, splits, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators import history as H
from faultline.operators.quantiles import exact_quantiles


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, specificity and false-positive rate from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    return df.withColumns({
        "f1": _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "specificity": _ratio(tn, tn + fp), "fpr": _ratio(fp, fp + tn)})


def confusion_metrics(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label).cast("boolean"), predicted
    counts = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return _rates(counts)


def apply_threshold(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Metrics and predicted rate after deciding anew at ``threshold``."""
    out = confusion_metrics(df, label, F.col(score) >= threshold)
    return out.withColumn("predicted_rate", (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def ranked_counts(df: DataFrame, score: str, groups: dict[str, Column], by: Sequence[str] = (), slots: int = 4096) -> DataFrame:
    """Per distinct score: the rows of each group at it (``g``), below it (``g_below``) and in total (``g_all``).

    Scores fall into value slots first. Running totals over the few slots are the base of each
    slot, and only the distinct scores of one slot are ordered together: no global sort.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(*[F.count_if(c).alias(g) for g, c in groups.items()])
    # slots of equal width between the smallest and the largest score, whatever their range
    ends = counts.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("_slot", F.coalesce(F.floor((F.col("score") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * slots), F.lit(0))).drop("_lo", "_hi")  # one row
    per = counts.groupBy(*by, "_slot").agg(*[F.sum(g).alias(g) for g in groups])
    w, all_ = W.partitionBy(*by).orderBy("_slot"), W.partitionBy(*by)
    base = per.select(*by, "_slot", *[(F.sum(g).over(w) - F.col(g)).alias(f"_b_{g}") for g in groups], *[F.sum(g).over(all_).alias(f"{g}_all") for g in groups])
    ws = W.partitionBy(*by, "_slot").orderBy("score")
    out = counts.join(base, [*by, "_slot"])
    return out.select(*by, "score", *groups, *[f"{g}_all" for g in groups],
                      *[(F.col(f"_b_{g}") + F.sum(g).over(ws) - F.col(g)).alias(f"{g}_below") for g in groups])


def _pos_neg(label: str) -> dict[str, Column]:
    y = F.col(label).cast("boolean")
    return {"pos": y, "neg": ~y}


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area under the ROC curve: the Mann-Whitney statistic over distinct scores."""
    r = ranked_counts(df, score, _pos_neg(label), by)
    u = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    return r.groupBy(*by).agg(F.coalesce(u / F.nullif(F.max("pos_all").cast("double") * F.max("neg_all"), F.lit(0.0)), F.lit(0.5)).alias("auc"))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per threshold (every distinct score): tp, fp, tpr, fpr, precision, recall, f1."""
    r = ranked_counts(df, score, _pos_neg(label))
    out = r.select(F.col("score").alias("threshold"), (F.col("pos_all") - F.col("pos_below")).alias("tp"), (F.col("neg_all") - F.col("neg_below")).alias("fp"),
                   F.col("pos_below").alias("fn"), F.col("neg_below").alias("tn"), "pos", F.col("pos_all"))
    return _rates(out).withColumn("tpr", F.col("recall"))


def curve_summary(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision, best-F1 threshold and the first threshold with FPR at least 1, 5 and 10%."""
    c = curve_points(df, label, score)
    first = lambda x: F.max(F.when(F.col("fpr") >= x, F.col("threshold")))
    return c.agg(
        F.sum(F.col("precision") * F.col("pos") / F.col("pos_all")).alias("average_precision"),
        F.max_by("threshold", F.struct(F.round("f1", 12), "threshold")).alias("best_threshold"), F.max("f1").alias("best_f1"),
        first(0.01).alias("at_fpr_01"), first(0.05).alias("at_fpr_05"), first(0.10).alias("at_fpr_10"))


def sweep_thresholds(step: float = 0.05, low: float = 0.10, count: int = 17) -> list[float]:
    return [round(low + i * step, 6) for i in range(count)]


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Metrics at each threshold. A row only counts how many thresholds it reaches; the rest is a running sum over those few counts."""
    by, ts = list(by), sorted(thresholds)
    reach = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ts]), lambda t: F.col(score) >= t))
    counts = df.groupBy(*by, reach.alias("k")).agg(*[F.count_if(c).alias(n) for n, c in _pos_neg(label).items()])
    long = counts.select(*by, "k", "pos", "neg", F.posexplode(F.array(*[F.lit(float(t)) for t in ts])).alias("i", "threshold"))
    over = F.col("k") > F.col("i")
    out = long.groupBy(*by, "threshold").agg(
        F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(over, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(over, 0).otherwise(F.col("neg"))).alias("tn"))
    return _rates(out)


def pick_threshold(sweep: DataFrame, rule: str = "calibrated") -> DataFrame:
    """``calibrated``: best (f1, recall, threshold); ``first_best``: the lowest threshold with the best f1."""
    s = sweep.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})
    key = F.struct("f1", "recall", "threshold") if rule == "calibrated" else F.struct(F.col("f1"), -F.col("threshold"))
    return s.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), key).alias("b")).select("b.*")


def threshold_by_cost(sweep: DataFrame, max_fpr: float = 0.05, min_recall: float = 0.9, fp_cost: float = 100.0, miss_cost: float = 10000.0,
                      daily: float = 10000.0, attacks_per_year: float = 10.0) -> DataFrame:
    """Daily cost of each threshold; the best allowed one (f1 minus cost / 1000), else the cheapest."""
    s = sweep.withColumns({"fp_cost_per_day": F.col("fpr") * fp_cost, "miss_cost_per_day": (1 - F.col("recall")) * attacks_per_year * miss_cost / 365})
    s = s.withColumn("daily_cost", F.col("fp_cost_per_day") + F.col("miss_cost_per_day"))
    s = s.withColumns({"allowed": (F.col("fpr") <= max_fpr) & (F.col("recall") >= min_recall), "objective": F.col("f1") - F.col("daily_cost") / 1000})
    row = F.struct("threshold", "f1", "recall", "fpr", "daily_cost")
    best = s.agg(F.max_by(row, F.when(F.col("allowed"), F.struct(F.round("objective", 9), -F.col("threshold")))).alias("a"),
                 F.min_by(row, F.struct(F.round("daily_cost", 9), "threshold")).alias("b"), F.max("allowed").alias("found"))
    return best.select(F.when(F.col("found"), "optimal_found").otherwise("best_compromise").alias("status"), F.when(F.col("found"), F.col("a")).otherwise(F.col("b")).alias("r")).select("status", "r.*")


def cost_benefit(chosen: DataFrame, attacks: float = 50.0, loss: float = 25_000.0, system_cost: float = 50_000.0, fp_cost: float = 100.0) -> DataFrame:
    """Yearly benefit and cost of a chosen threshold row, the return in percent, the attack cost that breaks even, and
    the return with twice and half the attacks or twice the cost of one."""
    out = chosen.withColumns({"prevented": F.col("recall") * attacks, "cost": F.lit(system_cost) + F.col("fpr") * 365 * fp_cost}).withColumn("benefit", F.col("prevented") * loss)
    back = lambda times: (times * F.col("benefit") - F.col("cost")) / F.col("cost") * 100
    return out.withColumns({
        "net_benefit": F.col("benefit") - F.col("cost"), "roi_percent": back(1.0), "break_even_attack_cost": F.col("cost") / F.greatest("prevented", F.lit(1.0)),
        "roi_double_attacks": back(2.0), "roi_half_attacks": back(0.5), "roi_double_attack_cost": back(2.0)}).withColumns({
        "financially_justified": F.col("roi_percent") > 200, "risk": F.when(F.col("roi_percent") > 500, "low").when(F.col("roi_percent") > 200, "medium").otherwise("high")})


def score_gap(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("boolean")
    s = lambda f, c: f(F.when(c, F.col(score)))
    out = df.agg(F.count_if(~y).alias("benign_n"), s(F.min, ~y).alias("benign_min"), s(F.max, ~y).alias("benign_max"), s(F.avg, ~y).alias("benign_mean"),
                 F.count_if(y).alias("anomaly_n"), s(F.min, y).alias("anomaly_min"), s(F.max, y).alias("anomaly_max"), s(F.avg, y).alias("anomaly_mean"))
    return out.withColumn("gap", F.col("anomaly_min") - F.col("benign_max"))


def _shuffled_position(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Position of a row within its class in a seeded random order, without sorting a class in one task."""
    salted = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)))
    return H.index_rows(salted, [label], "_h", id_col, slot=1 << 30).drop("_h")


def stratified_kfold(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    return _shuffled_position(df, label, id_col, seed).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "key_rows")


def benign_split(df: DataFrame, label: str, id_col: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """``train`` of the benign rows for fitting; everything else for testing."""
    rows = _shuffled_position(df, label, id_col, seed)
    fit = (~F.col(label).cast("boolean")) & (F.col("rn") <= F.floor(F.col("key_rows") * train))
    return rows.withColumn("part", F.when(fit, "train").otherwise("test")).drop("rn", "key_rows")


def compare_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Effect size, t, Mann-Whitney U, Wilcoxon W, Cliff's delta and the confidence interval of the mean difference."""
    base = pairs.agg(F.count(a).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"),
                     F.var_samp(a).alias("sa"), F.var_samp(b).alias("sb"))
    both = pairs.select(F.inline(F.array(F.struct(F.col(a).alias("score"), F.lit(True).alias("is_a")), F.struct(F.col(b).alias("score"), F.lit(False).alias("is_a")))))
    r = ranked_counts(both, "score", {"x": F.col("is_a"), "y": ~F.col("is_a")})
    u = r.agg(F.sum(F.col("x").cast("double") * (F.col("y_below") + F.col("y") / 2)).alias("u"),
              F.sum(F.col("x").cast("double") * F.col("y_below")).alias("more"), F.sum(F.col("x").cast("double") * (F.col("y_all") - F.col("y_below") - F.col("y"))).alias("less"))
    diff = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select(F.abs("d").alias("score"), (F.col("d") > 0).alias("up"))
    q = ranked_counts(diff, "score", {"p": F.col("up"), "m": ~F.col("up")})
    rank = F.col("p_below") + F.col("m_below") + (F.col("p") + F.col("m") + 1) / 2
    w = q.agg(F.least(F.sum(F.col("p") * rank), F.sum(F.col("m") * rank)).alias("w"))
    out = base.crossJoin(F.broadcast(u)).crossJoin(F.broadcast(w))  # one row each
    return out.withColumns({
        "cohens_d": F.expr("coalesce((mean_a - mean_b) / nullif(sqrt(((n - 1) * va + (n - 1) * vb) / (2 * n - 2)), 0), 0)"),
        "t": F.expr("(mean_a - mean_b) / sqrt((sa + sb) / n)"),
        "cliffs_delta": F.expr("(less - more) / (CAST(n AS DOUBLE) * n)"),
        "ci_low": F.expr("mean_a - mean_b - 1.96D * sqrt(va / n + vb / n)"), "ci_high": F.expr("mean_a - mean_b + 1.96D * sqrt(va / n + vb / n)"),
    }).withColumn("effect", F.expr("CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END"))


def percentile_ci(df: DataFrame, value: str, probs: Sequence[float] = (0.5, 0.95, 0.99), z: float = 1.96) -> DataFrame:
    """Percentiles with their 95% bootstrap interval.

    Resampling n rows moves the rank of a percentile by a binomial spread, so the interval of
    endlessly many resamples is read off the order statistics directly: no resample is drawn.
    """
    n = df.where(F.col(value).isNotNull()).count()
    wanted = {}
    for p in probs:
        half = z * (p * (1 - p) / max(n, 1)) ** 0.5
        wanted[p] = (p, max(0.0, p - half), min(1.0, p + half))
    q = exact_quantiles(df, [], value, sorted({x for t in wanted.values() for x in t}))
    pick = lambda x: F.max(F.when(F.col("p") == x, F.col("q")))
    one = q.agg(F.array(*[F.struct(F.lit(float(p)).alias("p"), pick(m).alias("estimate"), pick(lo).alias("low"), pick(hi).alias("high")) for p, (m, lo, hi) in wanted.items()]).alias("x"))
    return one.select(F.inline("x"))


def latency_overhead(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Absolute and relative overhead of system b over system a."""
    x = a.agg(F.avg(value).alias("mean_a")).crossJoin(F.broadcast(b.agg(F.avg(value).alias("mean_b"))))  # one row each
    return x.withColumns({"absolute": F.col("mean_b") - F.col("mean_a"), "relative_percent": (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100})


def compare_detectors(scores: DataFrame, name: str = "detector", label: str = "label", score: str = "score", threshold: str = "threshold") -> DataFrame:
    """Metrics and AUC per detector, ranked by F1, then AUC. ``scores`` is long: detector, label, score, threshold."""
    m = confusion_metrics(scores, label, F.col(score) > F.col(threshold), [name]).join(roc_auc(scores, label, score, [name]), name)
    return m.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("auc", 9)), name)))  # one row per detector


def latency_report(runs: DataFrame, stages: Sequence[str], total: str = "total_ms", cold: str = "cold") -> DataFrame:
    """Latency of warm runs in one row: mean, p50, p95, p99, sample deviation, mean of each stage, slowest stage, and what cold runs add."""
    warm = runs.where(~F.col(cold))
    q = exact_quantiles(warm, [], total, (0.5, 0.95, 0.99)).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)])
    means = warm.agg(F.count(F.lit(1)).alias("runs"), F.avg(total).alias("mean_ms"), F.coalesce(F.stddev_samp(total), F.lit(0.0)).alias("stdev_ms"), *[F.avg(s).alias(f"{s}_mean") for s in stages])
    first = runs.where(cold).agg(F.avg(total).alias("cold_ms"))
    slowest = F.array_max(F.array(*[F.struct(F.col(f"{s}_mean").alias("m"), F.lit(s).alias("s")) for s in stages]))["s"]
    out = means.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(first))  # one row each
    return out.withColumns({"slowest_stage": slowest, "cold_overhead_ms": F.col("cold_ms") - F.col("mean_ms"), "cold_factor": F.col("cold_ms") / F.nullif("mean_ms", F.lit(0.0))})
