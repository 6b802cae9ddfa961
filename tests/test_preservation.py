import math
import random

import numpy as np
import pandas as pd
import pytest

from faultline.operators import preservation as P

FIELDS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        x = None if i % 37 == 0 else rng.choice([1.0, 1.0, 1.0, 2.5, -4.0, rng.gauss(0, 5)])  # ties: half of the column is one value
        y, z = rng.gauss(3, 1), float(rng.randrange(5))
        out.append((x, y, z, None if x is None or i % 41 == 0 else x + rng.choice([0, 0, 1.5]), y * 0.8 + (x or 0) * 0.1, z if i % 3 else 0.0,
                    rng.choice(["", "ab1", "héllo w", None]), rng.choice(["", "zz", "12345"])))
    return out


@pytest.fixture(scope="module")
def pairs(spark, rows):
    names = [f"o_{f}" for f in FIELDS] + [f"p_{f}" for f in FIELDS]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", o_t string, p_t string").repartition(5)


def close(a, b):
    return max(0.0, 1 - abs(a - b) / (abs(a) + 1e-10))


def test_distribution_fidelity(pairs, rows):
    got = {r.field: r for r in P.distribution_fidelity(pairs, FIELDS).collect()}
    for i, f in enumerate(FIELDS):
        a, b = (np.array([r[k] for r in rows if r[k] is not None]) for k in (i, i + 3))
        moment = lambda v, k: float(np.mean((v - v.mean()) ** k))
        values = np.unique(np.concatenate([a, b]))
        share = lambda v: np.searchsorted(np.sort(v), values, side="right") / len(v)
        gap = np.abs(share(a) - share(b))
        want = {"mean": close(a.mean(), b.mean()), "variance": close(a.var(), b.var()), "skewness": close(*[moment(v, 3) / v.var() ** 1.5 for v in (a, b)]),
                "kurtosis": close(*[moment(v, 4) / v.var() ** 2 - 3 for v in (a, b)]), "ks": 1 - gap.max(), "emd": max(0.0, 1 - float((gap[:-1] * np.diff(values)).sum()) / (a.max() - a.min())),
                "quantiles": float(np.mean([close(np.quantile(a, q), np.quantile(b, q)) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))}
        for n, v in want.items():
            assert got[f][n] == pytest.approx(v, abs=1e-6), (f, n)
        assert got[f].overall == pytest.approx(sum(want.values()) / 7, abs=1e-6)


def test_correlation_fidelity(pairs, rows):
    structure, ranks = P.correlation_fidelity(pairs, FIELDS)
    d = pd.DataFrame([r[:6] for r in rows])
    for r in ranks.collect():
        i = FIELDS.index(r.field)
        both = d[[i, i + 3]].dropna()
        assert r.rank_correlation == pytest.approx(max(0.0, np.corrcoef(both[i].rank(), both[i + 3].rank())[0, 1]))
    one = structure.collect()
    a, b = (d[[0 + k, 1 + k, 2 + k]].corr().to_numpy() for k in (0, 3))
    up = np.triu_indices(3, 1)
    assert len(one) == 1 and one[0].fidelity == pytest.approx(1 - np.abs(a - b).mean()) and one[0].structure == pytest.approx(max(0.0, np.corrcoef(a[up], b[up])[0, 1]))


def test_pattern_fidelity(pairs, rows):
    got = {r.field: r for r in P.pattern_fidelity(pairs, [*FIELDS, "t"]).collect()}

    def number(a, b):
        return max(0.0, 1 - abs(a - b) / abs(a)) if a else 1.0 if b == 0 else 0.5

    def text(a, b):
        if a and b:
            share = [sum(c.isalpha() for c in s) / len(s) for s in (a, b)]
            return (min(len(a), len(b)) / max(len(a), len(b)) + 1 - abs(share[0] - share[1])) / 2
        return 1.0 if a == b else 0.0

    for f, (i, j, score) in {"x": (0, 3, number), "y": (1, 4, number), "z": (2, 5, number), "t": (6, 7, text)}.items():
        held = [(r[i], r[j]) for r in rows if r[i] is not None]
        kept = [p for p in held if p[1] is not None]
        assert got[f].presence == pytest.approx(len(kept) / len(held)) and got[f].type_kept == 1.0
        assert got[f].pattern == pytest.approx(sum(score(*p) for p in kept) / len(kept)), f


def test_edges(spark, pairs):
    none = pairs.where("false")
    assert P.distribution_fidelity(none, FIELDS).count() == 0
    assert [(r.presence, r.pattern) for r in P.pattern_fidelity(none, ["x", "t"]).collect()] == [(None, None)] * 2
    assert P.correlation_fidelity(none, FIELDS)[1].count() == 0
    flat = spark.createDataFrame([(1.0, 1.0, 4.0, 4.0, "a", 2)] * 5, "o_x double, p_x double, o_y double, p_y double, o_t string, p_t int")
    r = P.distribution_fidelity(flat, ["x"]).first()
    assert r["mean"] == r["variance"] == r["ks"] == r["quantiles"] == 1.0 and r["skewness"] is None and r["kurtosis"] is None and math.isclose(r["overall"], 1.0)
    structure, ranks = P.correlation_fidelity(flat, ["x", "y"])
    assert [r.rank_correlation for r in ranks.collect()] == [None, None] and structure.first().structure is None
    with pytest.raises(ValueError):
        P.correlation_fidelity(flat, ["x"])
    t = P.pattern_fidelity(flat, ["t"]).first()
    assert (t.presence, t.type_kept, t.pattern) == (1.0, 0.5, None)
