import math

import numpy as np

from faultline.llm import vectors
from faultline.llm.components import components
from helpers import classes, same_as_sql

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, rep bigint, cell int"


def naive(rows, least=0.93):
    ok = {}
    for k, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e, np.float32).astype(np.float64)
            ok[k] = (label, v / np.linalg.norm(v))
    link = lambda a, b: ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and float(ok[a][1] @ ok[b][1]) >= least
    n = {k: sum(link(k, j) for j in ok if j != k) for k in ok}
    of = classes(ok, link)
    low = {}
    for k, c in of.items():
        low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return [(i, n.get(k, 0), low[of[k]] if k in of else i, i is not None and (low[of[k]] if k in of else i) == i) for k, (i, _, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def clustered(seed, n=160, dim=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    return rows + [(1000 + i, rows[3][1], rows[3][2]) for i in range(5)]


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op6_embedding_near_dedup", vectors.QUERIES, vectors.ORACLES)


def test_many_pivots_and_small_tiles(spark):
    rows = clustered(1)
    for sizes in ({"per_pivot": 10, "tile": 7}, {"per_pivot": 40, "tile": 1000}, {"per_pivot": 10**9, "tile": 30}):
        got = [tuple(r) for r in vectors.near_duplicates(frame(spark, rows), **sizes).collect()]
        assert sorted(got) == sorted(naive(rows))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (2, [1.0, 0.001], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0),
            (9, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0), (12, [1e-30, 0.0], 0)]
    got = [tuple(r) for r in vectors.near_duplicates(frame(spark, rows)).collect()]
    want = [(i, n, c, k) for i, n, c, k in naive(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert vectors.near_duplicates(frame(spark, rows[:1]).filter("false")).count() == 0


def test_components_of_paths_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 300 + i) for i in range(40)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in [200, *range(300, 340)]} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
