"""Filter interaction audit: what each order of filters removes, and each filter's Shapley value from potentials of removal games."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm.common import store, table

#: the white space that separates words, as a pattern of what to split at
GAPS = r"[\x20\x09-\x0D]+"
#: the conditions under which a text fails, by the letter of its filter; E, the duplicate filter, needs the whole table
ALONE = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * regexp_count(text, '[A-Z]') > 2 * char_length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
REPEATED = "E"


def failures(docs: DataFrame, alone: dict[str, str] = ALONE, repeated: str = REPEATED, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep..., mask), one row per row: bit i is set where the text fails the i-th filter, the duplicate filter being the last.

    ``alone`` holds SQL conditions on ``text`` and its ``words`` (an array). A text fails ``repeated`` if it is identical to the text
    of a smaller id anywhere in the table. Texts are compared by their SHA-256: the first holder of each digest is found by
    one grouped minimum, which is pre-aggregated, and joined back by digest and id, so a text that a third of
    all rows share is spread by its ids. A null text counts as empty; a row of null id is never a repetition and no reference;
    rows that repeat the smallest id of their text are no repetitions either.
    """
    own = docs.select(F.col(id_col).cast("long").alias("__id"), *[F.col(c).alias(f"__{c}") for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = own.withColumn("words", F.array_remove(F.split("text", GAPS), ""))
    bits = sum((F.when(F.expr(cond), 1 << i).otherwise(0) for i, cond in enumerate(alone.values())), F.lit(0))
    marked = store(split.select("__id", *[f"__{c}" for c in keep], bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = marked.filter("__id IS NOT NULL").groupBy("digest").agg(F.min("__id").alias("__id")).withColumn("first", F.lit(True))
    told = marked.join(first, ["digest", "__id"], "left")
    again = F.when(F.col("first").isNull() & F.col("__id").isNotNull(), 1 << len(alone)).otherwise(0)
    return told.select(F.col("__id").alias("id"), *[F.col(f"__{c}").alias(c) for c in keep], F.col("mask").bitwiseOR(again).alias("mask"))


def coalitions(marked: DataFrame, n: int, measures: dict[str, Column], part_col: str = "part") -> DataFrame:
    """(part, total_m and v_m for each measure m): v_m is an array that holds, for each of the 2^n coalitions of filters, how much it removes.

    Rows are counted by part and mask first, at most 2^n rows a part, so no part is gathered.
    """
    counted = marked.groupBy(F.col(part_col).alias("part"), "mask").agg(*[F.sum(c).cast("long").alias(m) for m, c in measures.items()])
    seen = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("seen"))
    total = {f"total_{m}": F.expr(f"aggregate(seen, 0L, (t, e) -> t + e.{m})") for m in measures}
    value = {f"v_{m}": F.expr(f"transform(sequence(0, {2**n - 1}), s -> aggregate(seen, 0L, (t, e) -> t + if(e.mask & s = 0, 0L, e.{m})))") for m in measures}
    return seen.select("part", *[c.alias(k) for k, c in {**total, **value}.items()])


def potentials(v: str, n: int) -> Column:
    """n! times the Hart-Mas-Colell potential of each coalition of a game ``v`` (the name of an array over coalitions).

    P(S) = (v(S) + sum of P(S without i) over the members i) / |S|, P of nobody is 0. A coalition's subsets have smaller
    numbers, so one fold in number order has them all. n! P(S) is whole for every S.
    """
    members = ", ".join(str(1 << i) for i in range(n))
    less = f"aggregate(array({members}), 0L, (t, b) -> t + if(s & b = 0, 0L, p[s - b]))"
    return F.expr(f"aggregate(sequence(1, {2**n - 1}), array(0L), (p, s) -> concat(p, array(({factorial(n)}L * {v}[s] + {less}) div bit_count(s))))")


def audit(marked: DataFrame, names: str, measures: dict[str, Column] | None = None, part_col: str = "part") -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does to the part's documents (part, mask).

    Filter i has bit i of ``mask`` and letter i of ``names`` (at most 8). The first of ``measures`` must count documents; for each
    further one, ``m``, m_lost adds up what the step removes. Steps are differences of coalitions: the filter that comes after the
    coalition S removes v(S with it) - v(S). shapley is n! times the filter's Shapley value, its removals summed over all orders:
    the potential of all filters minus the potential without it. An empty table gives an empty table.
    """
    n, (count, *others) = len(names), list(measures or {"n": F.lit(1)})
    games = coalitions(marked, n, measures or {"n": F.lit(1)}, part_col)
    games = games.withColumn("p", potentials(f"v_{count}", n))
    bit = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(1 << i))])
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)]))
    steps = games.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    earlier = F.aggregate(F.split(F.expr("substring(filter_order, 1, step - 1)"), ""), F.lit(0), lambda m, c: m.bitwiseOR(F.coalesce(bit[c], F.lit(0))))
    at = steps.withColumns({"before": earlier, "bit": bit[F.expr("substring(filter_order, step, 1)")]}).withColumn("after", F.expr("before | bit"))
    everyone = 2**n - 1
    return at.select(
        "part", "filter_order", "step", F.expr(f"total_{count} - v_{count}[after]").alias("kept"), F.expr(f"v_{count}[after] - v_{count}[before]").alias("removed"),
        F.expr(f"v_{count}[bit] - (v_{count}[after] - v_{count}[before])").alias("redundant"), F.expr(f"v_{count}[{everyone}] - v_{count}[{everyone} - bit]").alias("unique_fails"),
        *[F.expr(f"v_{m}[after] - v_{m}[before]").alias(f"{m}_lost") for m in others], F.expr(f"p[{everyone}] - p[{everyone} - bit]").alias("shapley"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over `documents` by source; a document with several label rows is good or toxic if one of them says so."""
    docs = table(spark, sf_dir, "documents").withColumn("part", F.coalesce("source", F.lit("")))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    marked = failures(docs, keep=("part",)).join(labels, "id", "left")
    return audit(marked, "".join(ALONE) + REPEATED, {"n": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS b, coalesce(list_sum(bits[1:k - 1]), 0)::BIGINT AS before FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, b,
  sum(n) FILTER ((mask & (before | b)) = 0) AS kept, sum(n) FILTER ((mask & b) > 0 AND (mask & before) = 0) AS removed,
  sum(n) FILTER ((mask & b) > 0 AND (mask & before) > 0) AS redundant, sum(n) FILTER (mask = b) AS unique_fails,
  sum(good) FILTER ((mask & b) > 0 AND (mask & before) = 0) AS good_lost, sum(toxic) FILTER ((mask & b) > 0 AND (mask & before) = 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, b), 0)::BIGINT AS shapley FROM r"""

QUERIES = {"op11_filter_audit": op11}
ORACLES = {"op11_filter_audit": ORACLE}
