import hashlib
import random
from collections import defaultdict

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from faultline.llm import mixing, pieces
from faultline.llm.common import store
from helpers import classes, edge_docs
from test_darts import naive as near_classes
from test_lines import near_line


def naive_lines(rows):
    """The line stage over (id, text) by brute force: repeated lines go, but a document that is mostly one earlier document stays whole."""
    first = {}
    for i, text in sorted(rows):
        for no, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (i, no))
    of = classes(first, near_line)
    low = {}
    for line, c in of.items():
        low[c] = min(low.get(c, first[line]), first[line])
    out = {}
    for i, text in rows:
        ls = text.split("\n")
        origin = {no: low[of[x]][0] for no, x in enumerate(ls) if x.strip() and low[of[x]] != (i, no)}
        shared = defaultdict(int)
        for no, o in origin.items():
            shared[o] += len(ls[no])
        if shared and max(shared.values()) < 0.75 * sum(map(len, ls)):
            text = "\n".join(x for no, x in enumerate(ls) if no not in origin)
            if not text.strip():
                continue
        out[i] = text
    return out


def test_stages_against_brute_force(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(pipeline.STAGES)
    named = stages["language ID"](spark, docs, sf_dir)
    kept = {r["doc_id"]: r for r in named.collect()}
    assert named.columns == docs.columns
    assert {i for i, t, *_ in documents if t and any(c.isalpha() for c in t)} == kept.keys()  # only texts without letters go here
    lined = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, named, sf_dir).collect()}
    assert lined == naive_lines([(i, r["text"]) for i, r in kept.items()])
    frame = named.drop("text").join(spark.createDataFrame(list(lined.items()), "doc_id bigint, text string"), "doc_id").select(*docs.columns)
    of = near_classes(list(lined.items()))
    single = stages["MinHash near-dedup"](spark, frame, sf_dir)
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in of.items() if i == c}
    drawn = {r["doc_id"] for r in stages["mixing sources to target weights"](spark, single, sf_dir).collect()}
    assert drawn == {r["doc_id"] for r in mixing.mix(single).collect() if r["__kept"]}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    final = {r["doc_id"]: (r["ids"], r["n_tokens"], r["decoded_sha256"]) for r in pipeline.run(spark, sf_dir).collect()}
    ids = {i: sp.encode(lined[i], add_bos=True, add_eos=True) for i in drawn}
    assert final == {i: (x, len(x), hashlib.sha256(sp.decode(x).encode()).hexdigest()) for i, x in ids.items()}


def test_a_line_that_occurs_twice_loses_the_second(spark, sf_dir):
    own = [f"document {i} has this sentence number {i * 7919} to itself and some more words of its own to be longer" for i in range(9)]
    twice, often = "a passage that two documents of different text share", "a passage that six documents of different text share"
    texts = [f"{x}\n{twice}" if i < 2 else f"{x}\n{often}" if i < 8 else f"{own[0]}\n{often}\n{own[1]}" for i, x in enumerate(own)]
    docs = edge_docs(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.deduplicate_lines(spark, docs, sf_dir).collect()}
    want = {i: texts[i] if i in (0, 2) else own[i] for i in range(8)}  # the last one has nothing of its own
    assert got == {i: (t, len(t)) for i, t in want.items()} == {i: (t, len(t)) for i, t in naive_lines(list(enumerate(texts))).items()}


def test_blank_rest_goes(spark, sf_dir):
    a, b = "the first line of quite some length, held by one", "the second line of quite some length, held by another"
    texts = [a, b, f"{a}\n\n\n{b}", f"{b}\n\t\n{a}", f"{a}\n\u00a0\u2003\n{b}", "own\n\n"]
    docs = edge_docs(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    assert {r["doc_id"] for r in pipeline.deduplicate_lines(spark, docs, sf_dir).collect()} == {0, 1, 5}


def test_near_copies_meet_near_dedup_whole(spark, sf_dir):
    """Of each document and its near copy (one line of twelve changed) one stays, and no fragment of a line."""
    r = random.Random(3)
    rows = []
    for k in range(20):
        ls = [" ".join(f"w{r.randrange(100_000)}" for _ in range(9)) for _ in range(12)]
        near = [*ls[:5], " ".join(["other", "words", *ls[5].split()[2:]]), *ls[6:]]
        rows += [(k, "\n".join(ls)), (100 + k, "\n".join(near))]
    docs = edge_docs(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    lined = store(pipeline.deduplicate_lines(spark, docs, sf_dir))
    assert {x["doc_id"]: x["text"] for x in lined.collect()} == dict(rows)
    assert {x["doc_id"] for x in pipeline.deduplicate_documents(spark, lined, sf_dir).collect()} == set(range(20))


def test_without_any_label_all_documents_stay(spark, sf_dir):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.identify_language(spark, docs, sf_dir).count() == docs.count()


def test_edges(spark, sf_dir):
    docs = edge_docs(spark)
    for part in (docs, docs.filter("false"), docs.filter("text IS NULL")):
        step = part
        for _, stage in pipeline.STAGES[:-1]:
            step = store(stage(spark, step, sf_dir))
            assert step.columns == docs.columns
        assert pipeline.STAGES[-1][1](spark, step, sf_dir).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
        rows = step.collect()
        assert len(rows) <= part.count()
