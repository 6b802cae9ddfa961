import numpy as np

from faultline.llm import mixing
from helpers import edge_docs, edge_rows, same_as_sql


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op7_mixing", mixing.QUERIES, mixing.ORACLES)


def test_margins_meet_their_targets():
    rng = np.random.default_rng(1)
    levels = [rng.integers(0, k, 200) for k in (6, 4, 3)]
    n = rng.uniform(1, 100, 200)
    targets = []
    for x in levels:
        size = np.bincount(x, weights=n)
        targets.append(size**0.8 / (size**0.8).sum() * 0.4 * n.sum())
    p = mixing.fit(n, levels, targets)
    assert ((0 <= p) & (p <= 1)).all()
    for x, t in zip(levels, targets):
        assert np.allclose(np.bincount(x, weights=n * p), t, rtol=1e-6)


def test_a_level_that_is_too_small_is_taken_whole():
    p = mixing.fit(np.array([10.0, 1000.0]), [np.array([0, 1])], [np.array([500.0, 500.0])])
    assert p[0] == 1 and abs(p[1] - 0.5) < 1e-9


def test_many_cells_go_by_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = mixing.mark(docs).select(*[mixing.F.col(f"__{c}").alias(c) for c in (*mixing.MARGINS, "tokens")])
    small = {tuple(r)[:3]: r["p"] for r in mixing.probabilities(marked, rounds=8).collect()}
    large = {tuple(r)[:3]: r["p"] for r in mixing.probabilities(marked, rounds=8, driver_cells=1).collect()}
    assert small.keys() == large.keys()
    assert all(abs(small[k] - large[k]) < 1e-9 for k in small)


def test_sample_holds_the_share(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a b c d' AS text", "'en' AS lang", "concat('s', CAST(sqrt(id % 25) AS int)) AS source")
    out = mixing.mix(docs).groupBy("__source").agg(mixing.F.avg("__p").alias("p"), mixing.F.avg(mixing.F.col("__kept").cast("int")).alias("kept")).collect()
    assert all(abs(r["p"] - r["kept"]) < 0.05 for r in out)
    assert len({round(r["p"], 3) for r in out}) > 1


def test_edges(spark):
    out = mixing.mix(edge_docs(spark)).collect()
    assert len(out) == len(edge_rows())
    assert all(r["__kept"] is not None for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["__source"] == by[3]["__lang"] == "unknown" and by[3]["__tokens"] == 0 and by[10]["__topic"] == "general"
    assert mixing.mix(edge_docs(spark).filter("false")).count() == 0
