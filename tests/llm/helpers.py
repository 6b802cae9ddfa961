"""Shared by the tests of the training-data operators."""

import random
from collections import Counter

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def same_as_sql(spark, folder, name, queries, oracles):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries[name](spark, folder)
    rel = con.sql(oracles[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted(map(str, (tuple(r[i] for i in at) for r in rel.fetchall())))


def prose(seed, words=60, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(3)}" for _ in range(words))


def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, equal texts, no letters."""
    a, b = prose(1), prose(2, 30)
    return [
        (1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, None, None, None, None), (4, "", "en", "s1", 0), (5, "  \n\t ", "en", None, 4),
        (6, "1234 5678 !!", None, "s2", 12), (None, b, "de", "s2", 1), (7, b, "de", "s2", 1), (8, b + " tail", "de", "s2", 1), (9, prose(3, 30_000, 20_000), "de", "s2", 1),
        (10, f"{a}\n{b}\n{a}", "en", "s1", 1), (11, "😀 ﬁ ＡＢ ▁ x\u0000y\r\nz", "fr", "s3", 1), (12, "word", "en", "s1", 4),
    ]


def edge_docs(spark, rows=None):
    """The edge rows with extra columns whose names operators might use themselves."""
    rows = edge_rows() if rows is None else rows
    docs = spark.createDataFrame(rows, DOCS)
    extra = ["id", "line", "key", "size", "rank", "score", "hits", "spans", "gone", "component", "topic", "tokens", "p", "kept", "lang_pred", "text_b", "h1"]
    return docs.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(extra)])


def shingles(text, n=5):
    """Word shingles with their counts, as the near-duplicate operator defines them."""
    ws = [w.lower() for w in (text or "").encode().split()]
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if len(ws) >= n else Counter([tuple(ws)] if ws else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def classes(items, linked):
    """Smallest item reachable, by brute force over all pairs."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    items = list(parent)
    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}
