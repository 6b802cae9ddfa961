import hashlib
import random
from collections import Counter
from functools import lru_cache

from faultline.llm import lines
from helpers import classes, edge_docs, edge_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, n):
    b = list(a)
    for _ in range(n):
        kind, p = r.randint(0, 2), r.randint(0, len(b))
        if kind == 0:
            b.insert(p, r.choice("abé"))
        elif p < len(b):
            b[p : p + 1] = [] if kind == 1 else [r.choice("abc")]
    return "".join(b)


def test_band_and_keys_against_full_distance():
    r = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        pairs.append((a, edited(r, a, r.randint(0, 4))))
    for edits in (1, 2, 3):
        want = [distance(a, b) <= edits for a, b in pairs]
        assert lines.within(pairs, edits).tolist() == want
        for (a, b), near in zip(pairs, want):
            if near and min(len(a), len(b)) > edits:
                assert set(lines.keys(a, edits)) & set(lines.keys(b, edits))


def near_line(a, b, edits=2, shortest=24):
    """Two edits from 24 characters of the shorter line on, one from 12, else equality, by the full edit matrix."""
    most = min(edits, min(len(a), len(b)) * edits // shortest)
    if abs(len(a) - len(b)) > most or not most:
        return a == b
    x, y = bag(a), bag(b)
    return max(sum((x - y).values()), sum((y - x).values())) <= most and distance(a, b) <= most


@lru_cache(None)
def bag(line):
    return Counter(line)


def naive(rows, edits=2, shortest=24, least=2):
    """By brute force over all pairs of lines: of a class the first line stays; blank lines and rows of null id keep everything."""
    first, n = {}, Counter()
    for i, text in rows:
        if i is not None and text is not None:
            for no, line in enumerate(text.split("\n")):
                if line.strip():
                    first[line] = min(first.get(line, (i, no)), (i, no))
                    n[line] += 1
    of = classes(first, lambda a, b: near_line(a, b, edits, shortest))
    low, size = {}, Counter()
    for line, c in of.items():
        low[c] = min(low.get(c, first[line]), first[line])
        size[c] += n[line]
    out = []
    for i, text in rows:
        ls = [] if text is None else text.split("\n")
        kept = [x for no, x in enumerate(ls) if i is None or not x.strip() or size[of[x]] < least or low[of[x]] == (i, no)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def got(docs):
    return [tuple(r) for r in lines.deduplicate(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()]


def test_variants(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefghij ") for _ in range(r.randint(20, 60))) for _ in range(12)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.randint(0, 3)) for _ in range(r.randint(1, 6))), "en", "s", 1) for i in range(40)]
    assert sorted(got(edge_docs(spark, rows))) == sorted(naive([x[:2] for x in rows]))


def test_rare_lines_can_stay(spark):
    rows = [(i, "\n".join(f"this is a line of number {k} and more" for k in range(i, 8)), "en", "s", 1) for i in range(8)]
    want = [(i, 8 - i, n, k) for (i, _, n, k) in naive([x[:2] for x in rows], least=4)]
    assert sorted(tuple(r) for r in lines.deduplicate(edge_docs(spark, rows), least=4).select("doc_id", "n_lines", "n_removed", "kept").collect()) == sorted(want)


def test_short_lines(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefghij ") for _ in range(r.randint(1, 30))) for _ in range(25)] + ["All rights reserved.", "Yes.", "", "  ", "\r"]
    rows = [(i, "\n".join(edited(r, x, r.choice((0, 0, 1, 2))) if x.strip() else x for x in r.choices(base, k=r.randint(1, 8))), "en", "s", 1) for i in range(60)]
    want = sorted(naive([x[:2] for x in rows]))
    assert sorted(got(edge_docs(spark, rows))) == want
    seen = [x for _, text, *_ in rows for x in text.split("\n") if x.strip()]
    assert sum(n - 1 for x, n in Counter(seen).items() if len(x) < 12) > 20
    assert any(x != y and near_line(x, y) for x in set(seen) for y in set(seen) if len(x) < 24)


def test_query(spark, sf_dir, documents):
    want = {i: (n, m) for i, n, m, _ in naive([d[:2] for d in documents])}
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.op3(spark, sf_dir).collect()} == want


def test_query_with_planted_near_lines(spark, documents, tmp_path):
    r = random.Random(7)
    some = [x for _, t, *_ in documents[:120] for x in (t or "").split("\n") if len(x) >= 12][:400]
    planted = [(10_000 + k, "\n".join(edited(r, x, r.choice((1, 1, 2, 3))) for x in r.sample(some, 6))) for k in range(40)]
    rows = [(i, t) for i, t, *_ in documents[:120]] + planted
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in naive(rows)}
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"], x["kept_sha256"]) for x in lines.op3(spark, str(tmp_path)).collect()}
    assert got == want and sum(want[i][1] for i, _ in planted) > 100


def test_edges(spark):
    rows = edge_rows()
    assert sorted(map(str, got(edge_docs(spark)))) == sorted(map(str, naive([x[:2] for x in rows])))
    assert lines.deduplicate(edge_docs(spark).filter("false")).count() == 0
