"""What a transformation keeps: field equality, similarity, distributions, entropy, noise, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators.quantiles import exact_quantiles

# --- fixed values: fields that carry the anomaly signal ---
CRITICAL = ("execution_phase", "anomaly_type", "duration", "memory_spike_kb", "cpu_utilization", "network_io_bytes",
            "fallback_mode", "adversarial_score", "economic_risk_score")


def assess_preservation(pairs: DataFrame, fields: Sequence[str] = CRITICAL, before: str = "o_", after: str = "p_") -> DataFrame:
    """Share of fields kept (numbers within 1e-9) and the fields at risk, for rows with both versions."""
    types = dict(pairs.dtypes)
    have = sorted(f for f in fields if before + f in types)

    def same(f: str):
        a, b = F.col(before + f), F.col(after + f)
        return F.coalesce(F.abs(a - b) <= 1e-9, a.isNull() & b.isNull()) if types[before + f] in ("double", "float") else a.eqNullSafe(b)

    risk = F.array_compact(F.array(*[F.when(~same(f), F.lit(f)) for f in have]))
    return pairs.withColumn("at_risk", risk).withColumns({
        "preservation": F.round(1 - F.size("at_risk") / F.lit(float(len(have))), 4),
        "recommendation": F.when(F.size("at_risk") > 0, F.concat(
            F.size("at_risk").cast("string"), F.lit(" critical field(s) modified or lost: "), F.concat_ws(", ", "at_risk"))),
    })


# fixed bounds with assumed names: similarity bands
BANDS = ((0.95, "excellent"), (0.8, "good"), (0.6, "moderate"), (0.4, "poor"), (0.2, "critical"))


def transform_impact(pairs: DataFrame, fields: Sequence[str], before: str = "o_", after: str = "p_") -> DataFrame:
    """Mean feature similarity: 1 if equal, for numbers 1 minus the relative difference, else 0."""
    types = dict(pairs.dtypes)
    sims = []
    for f in fields:
        a, b = F.col(before + f), F.col(after + f)
        if types[before + f] in ("double", "float", "bigint", "int"):
            top = F.greatest(F.abs(a), F.abs(b)).cast("double")
            sims.append(F.when(a.eqNullSafe(b), 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.nullif(top, F.lit(0.0))), F.lit(0.0))))
        else:
            sims.append(a.eqNullSafe(b).cast("double"))
    total = sims[0]
    for s in sims[1:]:
        total = total + s
    level = F.lit("lost")
    for bound, name in reversed(BANDS):
        level = F.when(F.col("similarity") >= bound, name).otherwise(level)
    return pairs.withColumn("similarity", total / float(len(sims))).withColumn("level", level)


def char_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy (bits) of the characters of each text, counted with map-side combining."""
    chars = df.select(key, F.explode(F.split(text, "")).alias("c")).where("c <> ''")
    counts = chars.groupBy(key, "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy(key).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def _information(counts: DataFrame, value: str = "n") -> DataFrame:
    return counts.agg((F.log2(F.sum(value)) - F.sum(F.col(value) * F.log2(value)) / F.sum(value)).alias("bits"))


def field_entropy(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Entropy of each column's value distribution."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy("field").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """I(a; b) = H(a) + H(b) - H(a, b), from value counts."""
    pair = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    left, right = pair.groupBy(a).agg(F.sum("n").alias("n")), pair.groupBy(b).agg(F.sum("n").alias("n"))
    parts = (_information(left).select(F.col("bits").alias("v")).unionAll(_information(right)).unionAll(_information(pair).select(-F.col("bits"))))
    return parts.agg(F.sum("v").alias("mutual_information"))


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both; null where one of them is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlation_matrix(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """All pairwise Pearson correlations in one aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1:]]
    one = df.agg(*[_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "corr")
    return long.select(F.substring_index("pair", "|", 1).alias("a"), F.substring_index("pair", "|", -1).alias("b"), "corr")


def distribution_profile(df: DataFrame, fields: Sequence[str], probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Moments, percentiles and the share of IQR outliers per column."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    moments = long.groupBy("field").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))
    q = exact_quantiles(long, ["field"], "value", probs)
    wide = q.groupBy("field").pivot("p", list(probs)).agg(F.first("q"))
    wide = wide.select("field", *[F.col(f"`{p}`").alias(f"p{round(p * 100)}") for p in probs])
    low, high = F.expr("p25 - 1.5D * (p75 - p25)"), F.expr("p75 + 1.5D * (p75 - p25)")
    out = long.join(wide, "field").groupBy("field").agg(F.avg(((F.col("value") < low) | (F.col("value") > high)).cast("double")).alias("outlier_ratio"))
    return moments.join(wide, "field").join(out, "field")


def distribution_shift(pairs: DataFrame, fields: Sequence[str], before: str = "o_", after: str = "p_") -> DataFrame:
    """Kolmogorov-Smirnov distance and normalised earth mover's distance of each column, before and after.

    Both come from one pass over the distinct values: cumulative shares in value order.
    Distinct values are ranged into slots first, so no single task holds a whole column.
    """
    arms = []
    for f in fields:
        for side, sign in ((before, 1), (after, -1)):
            arms.append(F.struct(F.lit(f).alias("field"), F.col(side + f).cast("double").alias("value"), F.lit(sign).alias("sign")))
    long = pairs.select(F.inline(F.array(*arms))).where("value IS NOT NULL")
    counts = long.groupBy("field", "value").agg(F.count_if(F.col("sign") > 0).alias("a"), F.count_if(F.col("sign") < 0).alias("b"))
    edges = counts.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    slotted = counts.join(edges, "field").withColumn("slot", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(0))
    base = slotted.groupBy("field", "slot").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("value").alias("first"))
    w = W.partitionBy("field").orderBy("slot")
    base = base.select("field", "slot", (F.sum("sa").over(w) - F.col("sa")).alias("ca"), (F.sum("sb").over(w) - F.col("sb")).alias("cb"), F.lead("first").over(w).alias("after"))
    ws = W.partitionBy("field", "slot").orderBy("value")
    cum = slotted.join(base, ["field", "slot"]).select(
        "field", "lo", "hi", F.abs((F.col("ca") + F.sum("a").over(ws)) / F.col("na") - (F.col("cb") + F.sum("b").over(ws)) / F.col("nb")).alias("gap"),
        (F.coalesce(F.lead("value").over(ws), F.col("after"), F.col("value")) - F.col("value")).alias("width"))
    return cum.groupBy("field").agg(F.max("gap").alias("ks"), (F.sum(F.col("gap") * F.col("width")) / F.nullif(F.max("hi") - F.min("lo"), F.lit(0.0))).alias("emd"))


def utility_metrics(pairs: DataFrame, fields: Sequence[str], before: str = "o_", after: str = "p_") -> DataFrame:
    """Mean and variance kept (1 minus relative change), and correlation of the two versions."""
    aggs = []
    for f in fields:
        a, b = F.col(before + f).cast("double"), F.col(after + f).cast("double")
        aggs.append(F.struct(F.lit(f).alias("field"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), _corr(a, b).alias("corr")))
    kept = lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(F.col(x) - F.col(y)) / F.greatest(F.abs(F.col(x)), F.lit(1e-9)))
    return pairs.agg(F.array(*aggs).alias("x")).select(F.inline("x")).select(
        "field", kept("ma", "mb").alias("mean_kept"), kept("va", "vb").alias("variance_kept"), F.abs("corr").alias("correlation_kept"))


def _sides(pairs: DataFrame, fields: Sequence[str], before: str, after: str) -> DataFrame:
    """(field, side, value) of the numeric columns in both versions, nulls left out."""
    arms = [F.struct(F.lit(f).alias("field"), F.lit(side).alias("side"), F.col(p + f).cast("double").alias("value")) for f in fields for side, p in (("o", before), ("p", after))]
    return pairs.select(F.inline(F.array(*arms))).where("value IS NOT NULL")


def _from_zero(c: Column) -> Column:
    """Not below 0; unlike ``greatest`` a null stays null."""
    return F.when(c < 0, 0.0).otherwise(c)


def _fidelity(a: str, b: str) -> Column:
    """1 minus the change relative to the original, not below 0."""
    return _from_zero(1 - F.abs(F.col(a) - F.col(b)) / (F.abs(F.col(a)) + 1e-10))


def distribution_fidelity(pairs: DataFrame, fields: Sequence[str], before: str = "o_", after: str = "p_", probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """How well each numeric column keeps its distribution: four moments, Kolmogorov-Smirnov, earth mover's distance over the
    original's range, mean of the percentiles, and the mean of these seven. A score without a value (constant column, no rows) is null
    and left out of the mean."""
    long = _sides(pairs, fields, before, after)
    kinds = {"mean": F.avg, "variance": F.var_pop, "skewness": F.skewness, "kurtosis": F.kurtosis, "low": F.min, "high": F.max}
    wide = long.groupBy("field").agg(*[fn(F.when(F.col("side") == side, F.col("value"))).alias(f"{side}_{n}") for n, fn in kinds.items() for side in "op"])
    q = exact_quantiles(long, ["field", "side"], "value", probs).groupBy("field", "p").agg(*[F.max(F.when(F.col("side") == s, F.col("q"))).alias(f"{s}_q") for s in "op"])
    q = q.groupBy("field").agg(F.avg(_fidelity("o_q", "p_q")).alias("quantiles"))
    span = lambda lo, hi: F.col(hi) - F.col(lo)
    moved = F.col("emd") * (F.greatest("o_high", "p_high") - F.least("o_low", "p_low")) / (span("o_low", "o_high") + 1e-10)
    out = wide.join(distribution_shift(pairs, fields, before, after), "field", "left").join(q, "field", "left").select(
        "field", *[F.nanvl(_fidelity(f"o_{n}", f"p_{n}"), F.lit(None)).alias(n) for n in ("mean", "variance", "skewness", "kurtosis")],
        (1 - F.col("ks")).alias("ks"), _from_zero(1 - moved).alias("emd"), "quantiles")
    scores = F.array_compact(F.array("mean", "variance", "skewness", "kurtosis", "ks", "emd", "quantiles"))
    return out.withColumn("overall", F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(scores), F.lit(0)))


def pattern_fidelity(pairs: DataFrame, fields: Sequence[str], before: str = "o_", after: str = "p_") -> DataFrame:
    """(field, presence, type_kept, pattern): rows that keep a value, type (1 or, if it changes, .5), and likeness of the values.

    Numbers score 1 minus the relative change (of a zero: 1 if it stays, else .5); texts the mean of the ratio of their lengths and
    1 minus the change in the share of letters (two empty ones 1, one empty 0). Other types have no pattern, columns without values no presence.
    """
    types, out = dict(pairs.dtypes), []
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    for f in fields:
        a, b = F.col(before + f), F.col(after + f)
        kinds = [types[p + f] for p in (before, after)]
        if all(k.startswith(numeric) for k in kinds):
            x, y = a.cast("double"), b.cast("double")
            like = F.when(x != 0, _from_zero(1 - F.abs(x - y) / F.abs(x))).when(y == 0, 1.0).when(y.isNotNull(), 0.5)
        elif kinds == ["string", "string"]:
            la, lb = F.length(a), F.length(b)
            letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)
            like = F.when((la > 0) & (lb > 0), (F.least(la, lb) / F.greatest(la, lb) + 1 - F.abs(letters(a) - letters(b))) / 2).when((la == 0) & (lb == 0), 1.0).when(la.isNotNull() & lb.isNotNull(), 0.0)
        else:
            like = F.lit(None).cast("double")
        out.append(F.struct(F.lit(f).alias("field"), (F.count_if(a.isNotNull() & b.isNotNull()) / F.nullif(F.count(a), F.lit(0))).alias("presence"),
                            F.lit(1.0 if kinds[0] == kinds[1] else 0.5).alias("type_kept"), F.avg(like).alias("pattern")))
    return pairs.agg(F.array(*out).alias("x")).select(F.inline("x"))


def correlation_fidelity(pairs: DataFrame, fields: Sequence[str], before: str = "o_", after: str = "p_") -> tuple[DataFrame, DataFrame]:
    """What stays of the correlations: one row (structure, fidelity) over both matrices, and (field, rank_correlation) between the versions.

    ``structure`` correlates the pairwise coefficients, ``fidelity`` is 1 minus their mean absolute change over the whole matrix.
    Ranks come from running counts of distinct values and are joined to counts of distinct pairs, so no column is ever sorted in
    one task and a value that most rows share is one row. Needs two fields; without a spread coefficients are null.
    """
    if len(fields) < 2:
        raise ValueError("correlations need two fields")
    both = correlation_matrix(pairs, [before + f for f in fields]), correlation_matrix(pairs, [after + f for f in fields])
    strip = lambda df, p, name: df.select(F.substring("a", len(p) + 1, 1 << 20).alias("a"), F.substring("b", len(p) + 1, 1 << 20).alias("b"), F.col("corr").alias(name))
    joined = strip(both[0], before, "x").join(strip(both[1], after, "y"), ["a", "b"])
    k = len(fields)
    structure = joined.agg(_from_zero(_corr(F.col("x"), F.col("y"))).alias("structure"), _from_zero(1 - 2 * F.sum(F.abs(F.col("x") - F.col("y"))) / (k * k)).alias("fidelity"))
    arms = [F.struct(F.lit(f).alias("field"), F.col(before + f).cast("double").alias("x"), F.col(after + f).cast("double").alias("y")) for f in fields]
    counts = pairs.select(F.inline(F.array(*arms))).where("x IS NOT NULL AND y IS NOT NULL").groupBy("field", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts
    for c in "xy":
        per = counts.groupBy("field", c).agg(F.sum("n").alias("k"))
        ranked = ranked.join(_centred_ranks(per, c), ["field", c])
    w = lambda p, q: F.sum(F.col("n") * F.col(f"r{p}") * F.col(f"r{q}"))
    ranks = ranked.groupBy("field").agg((w("x", "y") / F.nullif(F.sqrt(w("x", "x")) * F.sqrt(w("y", "y")), F.lit(0.0))).alias("rank_correlation"))
    return structure, ranks.withColumn("rank_correlation", _from_zero(F.col("rank_correlation")))


def _centred_ranks(per: DataFrame, c: str, slots: int = 1024) -> DataFrame:
    """(field, c, r<c>): mean rank of each distinct value minus the mean of all ranks; running totals over value slots."""
    ends = per.groupBy("field").agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.sum("k").alias("all"))
    slotted = per.join(ends, "field").withColumn("slot", F.when(F.col("hi") > F.col("lo"), F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * slots)).otherwise(0))
    base = slotted.groupBy("field", "slot").agg(F.sum("k").alias("in_slot")).withColumn("base", F.sum("in_slot").over(W.partitionBy("field").orderBy("slot")) - F.col("in_slot"))
    upto = F.sum("k").over(W.partitionBy("field", "slot").orderBy(c))
    return slotted.join(base.drop("in_slot"), ["field", "slot"]).select("field", c, (F.col("base") + upto - F.col("k") + (F.col("k") + 1) / 2 - (F.col("all") + 1) / 2).alias(f"r{c}"))


def add_noise(df: DataFrame, column: str, epsilon: float, mechanism: str = "laplace", seed: int = 42, out: str | None = None) -> DataFrame:
    """Differential-privacy noise; sensitivity is 10% of the value, at least 1."""
    sens = F.greatest(F.lit(1.0), F.abs(F.col(column)) * 0.1)
    if mechanism == "laplace":
        u = F.rand(seed) - 0.5
        noise = -F.signum(u) * sens / epsilon * F.log(1 - 2 * F.abs(u) + 1e-15)
    else:
        noise = F.randn(seed) * sens / epsilon
    return df.withColumn(out or column, F.col(column) + noise)


def budget_ledger(uses: DataFrame, allowance: float, key: str = "budget_id", time: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Spent epsilon and delta per budget and mechanism, and whether the budget is exhausted."""
    per = uses.groupBy(key, "mechanism").agg(F.sum("epsilon").alias("epsilon"), F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("uses"))
    total = F.sum("epsilon").over(W.partitionBy(key))
    return per.withColumn("remaining", F.greatest(F.lit(0.0), F.lit(allowance) - total)).withColumn("exhausted", total >= allowance)


def behavioural_features(df: DataFrame) -> DataFrame:
    """Feature list of a record (name, value, importance x confidence) and a signature of its order."""
    # assumed values: feature -> importance, confidence
    spec = {"duration": (0.9, 0.95), "memory_spike_kb": (0.8, 0.9), "cpu_utilization": (0.7, 0.9), "network_io_bytes": (0.6, 0.85)}
    feats = F.array_sort(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(i * c).alias("weight")) for n, (i, c) in spec.items()]))
    text = F.concat_ws("|", F.transform(feats, lambda f: F.concat(f["name"], F.lit(":"), F.format_string("%.4f", f["value"]))))
    return df.withColumns({"behavioural_features": feats, "behavioural_signature": F.substring(F.sha2(text, 256), 1, 16)})
