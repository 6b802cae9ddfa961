import random

import numpy as np
import pyarrow as pa

from faultline.llm import darts
from helpers import classes, edge_docs, edge_rows, jaccard, prose, shingles


def naive(rows, least=0.8):
    """Class of each id: equal or similar texts are linked."""
    s = {i: shingles(t) for i, t in rows if i is not None}
    return classes(s, lambda a, b: bool(s[a]) and bool(s[b]) and jaccard(s[a], s[b]) >= least)


def got(docs):
    return {r["doc_id"]: (r["class_id"], r["kept"]) for r in darts.near_duplicates(docs).collect()}


def test_query(spark, sf_dir, documents):
    want = naive([d[:2] for d in documents])
    assert got(spark.read.parquet(f"{sf_dir}/documents.parquet")) == {i: (c, c == i) for i, c in want.items()}


def test_one_large_group_of_near_copies(spark):
    """Copies that resemble one text but not each other: many fail against their bucket's first document."""
    r = random.Random(4)
    base = prose(9, 150)
    rows = []
    for i in range(120):
        w = base.split()
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, prose(1000 + i), "en", "s", 1) for i in range(20)]
    want = naive([x[:2] for x in rows])
    assert len(set(want.values())) < 80
    assert {i: c for i, (c, _) in got(edge_docs(spark, rows)).items()} == want


def test_agreement_estimates_weighted_similarity():
    a, b = prose(1, 300, 30), prose(1, 300, 30)
    b = " ".join([*b.split()[:240], *prose(2, 60, 30).split()])
    for x, y in ((a, b), (a, a + " " + a), ("one two", "one two three four five six")):
        o, e, w = darts.shingles(pa.array([x, y]), 1)
        sig, _ = darts.signatures(o, e, w, 2, 4000)
        one = lambda t: shingles(t, 1)
        assert abs(np.mean(sig[0] == sig[1]) - jaccard(one(x), one(y))) < 0.04


def test_matches_are_exact():
    texts = [prose(k % 7, 40, 30) + " " + prose(k, 8) for k in range(30)] + ["a b", "a b", ""]
    s = [shingles(t) for t in texts]
    every = np.arange(len(texts))
    found = {(a, int(b)) for a, others in darts.matches(texts, every, every, 0.6) for b in others}
    assert found == {(a, b) for a in every for b in every if a != b and jaccard(s[a], s[b]) >= 0.6}


def test_edges(spark):
    out = darts.near_duplicates(edge_docs(spark)).collect()
    assert len(out) == len(edge_rows())
    by = {r["doc_id"]: r["class_id"] for r in out}
    assert by[1] == by[2] == 1 and by[7] == by[8] == 7
    assert all(by[i] == i for i in (3, 4, 5, 6, 9, 11, 12)) and by[None] is None
    assert darts.near_duplicates(edge_docs(spark).filter("false")).count() == 0
