import random

from faultline.llm import passages
from helpers import edge_docs, edge_rows, prose, same_as_sql


def naive(rows, n=13):
    first = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = {q for p in range(len(w) - n + 1) if i is not None and first[tuple(w[p : p + n])] < i for q in range(p, p + n)}
        out.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return out


def got(docs, **options):
    return [tuple(r) for r in passages.deduplicate(docs, **options).select("doc_id", "n_words", "n_removed", "kept").collect()]


def order(rows):
    return sorted(rows, key=str)


def overlapping(seed, n=60):
    r = random.Random(seed)
    shared = [prose(100 + k, 40) for k in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            w = r.choice(shared).split()
            a = r.randint(0, 20)
            parts += [prose(r.random(), r.randint(0, 15)), " ".join(w[a : a + r.randint(5, 40)])]
        rows.append((i * 3, "\n".join(parts), "en", "s", 1))
    return rows


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op2_substring_dedup", passages.QUERIES, passages.ORACLES)


def test_overlaps(spark):
    rows = overlapping(5)
    assert order(got(edge_docs(spark, rows))) == order(naive([r[:2] for r in rows]))


def test_split_shards_change_nothing(spark):
    rows = overlapping(6, 40)
    docs = edge_docs(spark, rows)
    want = order(naive([r[:2] for r in rows]))
    assert order(got(docs, shard=1)) == want  # every shared shard goes by single windows


def test_edges(spark):
    rows = edge_rows()
    assert order(got(edge_docs(spark))) == order(naive([r[:2] for r in rows]))
    assert passages.deduplicate(edge_docs(spark).filter("false")).count() == 0


def test_spans_of_an_automaton():
    r = random.Random(2)
    for _ in range(60):
        segs = sorted((r.randint(0, 5), [r.choice("ab") for _ in range(r.randint(1, 14))]) for _ in range(6))
        for (doc, seg), spans in zip(segs, passages.repeated_spans(segs, 4)):
            before = {tuple(s[p : p + 4]) for d, s in segs if d < doc for p in range(len(s) - 3)}
            assert {p for a, b in spans for p in range(a, b)} == {p for p in range(len(seg) - 3) if tuple(seg[p : p + 4]) in before}
