"""Mixing sources to target weights: bounded iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm.common import WORD, cut, store, table

MARGINS = ("source", "lang", "topic")
#: how far the shares of a margin move towards equal ones: target share ~ share ** power
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
SHARE, ROUNDS, MOST = 0.5, 200, 1e6
#: cells fitted on the driver; more are fitted as a table
DRIVER_CELLS = 100_000
#: a text's topic is the one with most matches, the first on a tie, `general` without any
TOPICS = {"legal": "[Ll]icen[cs]e|[Cc]opyright", "contact": "@|[+][0-9]", "technical": "token|password|secret|AKIA", "tabular": " [|] "}


def topic(text: Column) -> Column:
    hits = [F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for p in TOPICS.values()]
    most = F.greatest(*hits)
    out = F.when(most == 0, "general")
    for name, h in zip(TOPICS, hits):
        out = out.when(h == most, name)
    return out


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(id_: Column) -> Column:
    """A number in [0, 1) that depends on the id alone (its text; null as empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fit(cells: np.ndarray, levels: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """The probability of each cell: least(1, product of one factor for each margin's level), raked round by round."""
    factors = [np.ones(len(t)) for t in targets]
    p = np.ones(len(cells))
    for _ in range(rounds):
        before = p
        for m in range(len(levels)):
            now = np.bincount(levels[m], weights=cells * p, minlength=len(targets[m]))
            factors[m] = np.minimum(MOST, factors[m] * np.divide(targets[m], now, out=np.ones(len(now)), where=now > 0))
            p = np.minimum(1.0, np.prod([f[x] for f, x in zip(factors, levels)], axis=0))
        if np.abs(p - before).max(initial=0) < 1e-15:
            break
    return p


def fit_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """`fit` for more cells than the driver takes: each step is a grouped sum and a join, cut every round."""
    names = list(targets)
    state = cells.withColumns({f"f_{m}": F.lit(1.0) for m in names} | {"p": F.lit(1.0)})
    for m in names:
        state = state.join(targets[m], m)
    for _ in range(rounds):
        state = state.withColumn("before", F.col("p"))
        for m in names:
            now = state.groupBy(m).agg(F.sum(F.col("tokens") * F.col("p")).alias("now"))
            state = state.join(now, m).withColumn(f"f_{m}", F.least(F.lit(MOST), F.col(f"f_{m}") * F.when(F.col("now") > 0, F.col(f"t_{m}") / F.col("now")).otherwise(1.0))).drop("now")
            product = F.lit(1.0)
            for f in names:
                product = product * F.col(f"f_{f}")
            state = state.withColumn("p", F.least(F.lit(1.0), product))
        state = cut(state)
        if not state.filter(F.abs(F.col("p") - F.col("before")) >= 1e-15).limit(1).count():
            break
    return state.select(*names, "p")


def probabilities(marked: DataFrame, share: float = SHARE, powers: dict[str, float] | None = None, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, p): the sampling probability of each cell of (source, lang, topic, tokens).

    Each margin's target is ``share`` of all tokens, dealt to its levels in proportion to (their share) ** power. Raking
    multiplies a cell by one factor for each of its levels until all margins meet their targets, capped at 1: no document
    can be taken twice. A level whose target exceeds its tokens is taken whole.
    """
    powers = powers or POWERS
    cells = store(marked.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    rows = cells.limit(driver_cells + 1).collect()
    if len(rows) > driver_cells:
        targets = {}
        for m in MARGINS:
            level = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("n"))
            total = level.agg(F.sum("n").alias("all"), F.sum(F.pow("n", F.lit(powers[m]))).alias("raised")).first()
            targets[m] = level.select(m, F.when(F.col("n") > 0, F.pow("n", F.lit(powers[m])) / total["raised"] * share * total["all"]).otherwise(0.0).alias(f"t_{m}"))
        return fit_table(cells, targets, rounds)
    rows.sort(key=lambda r: tuple(r[m] for m in MARGINS))
    n = np.array([float(r["tokens"]) for r in rows])
    levels, targets = [], []
    for m in MARGINS:
        names = sorted({r[m] for r in rows})
        at = np.array([names.index(r[m]) for r in rows], int) if len(names) < 50 else np.searchsorted(np.array(names, object), np.array([r[m] for r in rows], object))
        size = np.bincount(at, weights=n, minlength=len(names))
        raised = np.where(size > 0, size ** powers[m], 0.0)
        levels.append(at)
        targets.append(raised / max(raised.sum(), 1e-300) * share * n.sum())
    p = fit(n, levels, targets, rounds)
    return cells.sparkSession.createDataFrame([(*(r[m] for m in MARGINS), float(x)) for r, x in zip(rows, p)], "source string, lang string, topic string, p double")


def mark(docs: DataFrame) -> DataFrame:
    """Adds __source, __lang, __topic, __tokens (null source or language: `unknown`)."""
    return docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "__topic": topic(F.col("text")), "__tokens": tokens(F.col("text"))})


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source, lang and any other columns) with __source, __lang, __topic, __tokens, __p and __kept.

    A row is kept if a number drawn from its id lies below the probability of its cell; rows that repeat an id are drawn
    alike. A cell whose documents hold no tokens has the probability of its levels. Null ids are drawn as one id. An empty table gives an
    empty table.
    """
    marked = mark(docs)
    cells = probabilities(marked.select(*[F.col(f"__{c}").alias(c) for c in (*MARGINS, "tokens")]), **options)
    cells = cells.select(*[F.col(c).alias(f"__{c}") for c in MARGINS], F.col("p").alias("__p"))
    # cells are groups of categories: broadcast as long as they are few, else joined by shuffle
    cells = F.broadcast(cells) if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS else cells
    return marked.join(cells, [f"__{c}" for c in MARGINS], "left").withColumn("__kept", draw(F.col("doc_id")) < F.col("__p"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), (F.round("__p", 6) + F.lit(0.0)).alias("probability"), F.col("__kept").alias("kept"))


def _oracle() -> str:
    hits = {k: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for k, p in TOPICS.items()}
    cases = " ".join(f"WHEN {h} = greatest({', '.join(hits.values())}) THEN '{k}'" for k, h in hits.items())
    target = lambda m: f"{SHARE} * (SELECT sum(tokens) FROM cells) * pow(n_{m}, {POWERS[m]}) / (SELECT sum(pow(n, {POWERS[m]})) FROM (SELECT sum(tokens) AS n FROM cells GROUP BY {m}))"
    step, source = "", "it"
    for i, m in enumerate(MARGINS):
        product = "least(1.0, " + " * ".join(f"f_{x}" for x in MARGINS) + ")"
        step = f"(SELECT * REPLACE (least({MOST}, f_{m} * CASE WHEN now > 0 THEN t_{m} / now ELSE 1.0 END) AS f_{m}) FROM (SELECT *, sum(tokens * {product}) OVER (PARTITION BY {m}) AS now FROM {source}))"
        step = f"(SELECT * EXCLUDE (now) FROM {step})"
        source = step
    return f"""
WITH RECURSIVE m AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN greatest({', '.join(hits.values())}) = 0 THEN 'general' {cases} END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM m GROUP BY ALL),
sized AS (SELECT *, {', '.join(f'sum(tokens) OVER (PARTITION BY {x}) AS n_{x}' for x in MARGINS)} FROM cells),
start AS MATERIALIZED (SELECT source, lang, topic, tokens, {', '.join(f'{target(x)} AS t_{x}' for x in MARGINS)} FROM sized),
it AS (SELECT 0 AS round, *, {', '.join(f'1.0::DOUBLE AS f_{x}' for x in MARGINS)} FROM start
  UNION ALL SELECT round + 1 AS round, * EXCLUDE (round) FROM {source} WHERE round < {ROUNDS}),
p AS (SELECT source, lang, topic, least(1.0, {' * '.join(f'f_{x}' for x in MARGINS)}) AS p FROM it WHERE round = {ROUNDS})
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p AS kept
FROM m JOIN p USING (source, lang, topic)"""


QUERIES = {"op7_mixing": op7}
ORACLES = {"op7_mixing": _oracle()}
