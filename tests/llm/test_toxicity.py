import numpy as np

from faultline.llm import toxicity
from helpers import edge_docs, edge_rows, prose


def lexicon():
    return toxicity.Lexicon({toxicity.fold("idiot").strip() + " ": 5.0, toxicity.fold("trash").strip(): 4.0}, ["trash can"], (-3.0, 1.0, 1.0))


def hits(text):
    return len(lexicon().hits(toxicity.fold(text)))


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ＩＤＩＯＴ") == toxicity.fold("id​iot")
    assert toxicity.fold("") == toxicity.fold(" ,. ").replace("  ", " ") or toxicity.fold(" ,. ").strip() == ""


def test_matching():
    assert hits("an idiot!") == 1 and hits("1d1ot") == 1 and hits("idiots") == 0 and hits("myidiot") == 0
    assert hits("trashy trash") == 2
    assert hits("the trash can, trash") == 1  # inside an exception phrase it does not count
    assert hits("") == hits("nothing here") == 0


def test_score_falls_with_length_and_rises_with_hits():
    s = lexicon().score
    assert s("idiot " + prose(1, 500)) < s("idiot " + prose(1, 20)) < s("idiot idiot trash " + prose(1, 20))
    assert s(None) == s("") == s("fine words")


def test_exceptions_are_learned(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = prose(i, 30) + (" you idiot" if toxic else " idiot proof" if i % 3 == 1 else "")
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(toxic)))
    lex = toxicity.learn(edge_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), least_weight=0.5)
    assert any("proof" in e for e in lex.exceptions)
    assert lex.score(prose(900, 30) + " you idiot") > 0.5 > lex.score(prose(901, 30) + " idiot proof")


def test_held_out(spark):
    out = toxicity.op8(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    y, p = np.array([r["toxic"] for r in out]), np.array([r["predicted"] for r in out])
    assert (y == p).mean() > 0.9 and p[y == 1].mean() >= 0.6 and p[y == 0].mean() < 0.05


def test_edges(spark):
    docs = edge_docs(spark)
    out = toxicity.score(docs, lexicon()).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs.filter("false"), lexicon()).count() == 0
    nothing = toxicity.learn(docs, spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id bigint, toxic int"))
    assert nothing.weights == {} and nothing.score("idiot") < 0.5
