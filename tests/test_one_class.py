import numpy as np
import pytest

from faultline.operators.one_class import one_class_svm


def test_share_outside_and_planted_outliers(spark):
    rng = np.random.default_rng(1)
    inner = rng.normal(0, 1, (600, 2))
    train = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(inner)], "id long, a double, b double")
    far = [(1000 + i, 6.0 * np.cos(i), 6.0 * np.sin(i)) for i in range(20)] + [(2000, None, 1.0)]
    test = train.unionAll(spark.createDataFrame([(i, None if a is None else float(a), float(b)) for i, a, b in far], "id long, a double, b double"))
    got = {r.id: r for r in one_class_svm(train, test, ["a", "b"], nu=0.1).collect()}
    assert len(got) == 621 and got[2000].decision is None and got[2000].score is None
    assert abs(np.mean([got[i].decision < 0 for i in range(600)]) - 0.1) <= 0.02
    assert all(got[1000 + i].decision < 0 for i in range(20))
    known = [r for r in got.values() if r.decision is not None]
    assert min(r.score for r in known) == 0 and max(r.score for r in known) == 1
    assert all((r.score > r.threshold) == (r.decision < 0) for r in known if abs(r.decision) > 1e-9)
    mid = np.median([got[i].decision for i in np.argsort((inner ** 2).sum(axis=1))[:100]])
    assert mid > np.median([got[i].decision for i in np.argsort((inner ** 2).sum(axis=1))[-100:]])


def test_empty_training_raises(spark):
    none = spark.createDataFrame([], "a double, b double")
    with pytest.raises(ValueError):
        one_class_svm(none, none, ["a", "b"])
