from collections import Counter
from itertools import permutations
import re

from pyspark.sql import functions as F

from faultline.llm import audit
from helpers import edge_docs, edge_rows, same_as_sql


def fails(rows):
    """The set of failed filters of each row, straight from the definitions."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        cond = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        out.append({k for k, v in cond.items() if v})
    return out


def naive(parts, failed, good, names):
    """Every order played through document by document."""
    rows, shapley = {}, Counter()
    for order in map("".join, permutations(names)):
        for part in set(parts):
            left = [k for k, p in enumerate(parts) if p == part]
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in failed[k]]
                all_f = [k for k, p in enumerate(parts) if p == part and f in failed[k]]
                left = [k for k in left if f not in failed[k]]
                shapley[part, f] += len(gone)
                rows[part, order, step] = (len(left), len(gone), len(all_f) - len(gone), sum(failed[k] == {f} for k in all_f), sum(good[k] for k in gone))
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in rows.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in df.collect()}


def rows_of_all_kinds():
    plain = " ".join(f"word{i}" for i in range(250))
    texts = [plain, plain, plain + " #", "few WORDS HERE", "same " * 300, "same " * 300, "A B | C", plain.upper(), plain.upper() + "&", "", None]
    more = [(100 + k, t, "en", ("s1", "s2", None)[k % 3], 1) for k, t in enumerate(texts * 2)]
    return edge_rows() + more


def test_against_play_through(spark):
    rows = rows_of_all_kinds()
    docs = edge_docs(spark, rows).withColumn("part", F.coalesce("source", F.lit("")))
    marked = audit.failures(docs, keep=("part", "n_chars"))
    good = {"n": F.lit(1), "good": F.expr("int(coalesce(n_chars, 0) = 1)")}
    got = result(audit.audit(marked, "ABCDE", good))
    assert got == naive([r[3] or "" for r in rows], fails(rows), [int(r[4] == 1) for r in rows], "ABCDE")
    assert len(got) == 120 * len({r[3] or "" for r in rows}) * 5
    # a table without rows has no parts
    assert audit.audit(audit.failures(docs.filter("false"), keep=("part",)), "ABCDE").count() == 0


def test_other_numbers_of_filters(spark):
    masks = [0, 1, 2, 3, 3, 5, 7, 6, 4]
    marked = spark.createDataFrame([("p", m) for m in masks], "part string, mask int")
    failed = [{c for i, c in enumerate("xyz") if m >> i & 1} for m in masks]
    want = naive(["p"] * len(masks), failed, [0] * len(masks), "xyz")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], 0, r["shapley"]) for r in audit.audit(marked, "xyz").collect()}
    assert got == want


def test_efficiency_of_the_shapley_values(spark, sf_dir):
    out = audit.op11(spark, sf_dir).filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert out and all(r["s"] == 120 * r["r"] for r in out)


def test_query(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op11_filter_audit", audit.QUERIES, audit.ORACLES)
