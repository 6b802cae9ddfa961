import hashlib

import numpy as np
import sentencepiece

from faultline.llm import pieces
from helpers import edge_docs, edge_rows

ODD = ["", " ", "  ", " a", "a ", "a  b\n c ", "\n", "▁", "▁ x▁▁y ", "x" * 300, "é\u0000 ñ\t b", "a\r\n b", "  \n  ", " ▁ ", "😀 ok", "ﬁ ＡＢ", "<s> </s> <unk> <0x41>", "\xa0a 　b"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_chunks_give_the_library_ids(documents):
    sp, t = library(), pieces.ChunkTable(pieces.model_path())
    texts = ODD + [x or "" for _, x, *_ in documents]
    assert [np.frombuffer(g, "<u4").tolist() for g in t.encode(texts)] == sp.encode(texts)


def test_a_small_table_changes_nothing():
    t = pieces.ChunkTable(pieces.model_path(), rows=3)
    assert [np.frombuffer(g, "<u4").tolist() for x in ODD for g in t.encode([x])] == [library().encode(x) for x in ODD]


def test_query(spark, sf_dir, documents):
    sp = library()
    want = set()
    for i, x, *_ in documents:
        ids = sp.encode(x or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in pieces.op10(spark, sf_dir).collect()} == want


def test_edges(spark):
    docs, sp = edge_docs(spark), library()
    coded = pieces.encode(docs, pieces.model_path())
    back = pieces.decode(coded, pieces.model_path()).collect()
    assert len(back) == len(edge_rows())
    assert sorted((r["ids"] for r in back)) == sorted(sp.encode(x or "", add_bos=True, add_eos=True) for _, x, *_ in edge_rows())
    assert all(r["text"] == sp.decode(r["ids"]) for r in back)
    assert {(r["n_tokens"]) for r in pieces.digests(docs.filter("text IS NULL"), pieces.model_path()).collect()} == {2}
    assert pieces.digests(docs.filter("false"), pieces.model_path()).count() == 0
