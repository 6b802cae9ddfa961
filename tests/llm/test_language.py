import numpy as np
import pytest

import corpus_pipeline as pipeline
from faultline.llm import language
from helpers import edge_docs, edge_rows


def naive_phrases(text, training):
    n, i = 0, 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in training:
            k += 1
        i, n = i + max(k, 1), n + 1
    return n


def model_of(samples):
    alphabet = {ord(c): i + 2 for i, c in enumerate("abcdefgh")}
    m = language.Model([], alphabet, [], [], [])
    for name, text in samples.items():
        nxt, n = language.suffix_automaton([language.symbols(text, m.alphabet_map).tolist()])
        m.langs.append(name)
        m.edges.append(np.array([(a, c, b) for a, row in enumerate(nxt) for c, b in row.items()], np.int32))
        m.states.append(n)
        m.sizes.append(len(text))
    return m


def test_phrases_match_substring_search():
    rng = np.random.default_rng(1)
    word = lambda n, k=4: "".join(rng.choice(list("abcdefgh"[:k]), n))
    samples = {"x": word(300), "y": word(200, 3), "z": word(50, 5)}
    m = model_of(samples)
    texts = [word(n, 6) for n in (1, 2, 5, 40, 700, 3000)] + ["", "zzz", "aqa"]
    got = m.phrases([language.symbols(t, m.alphabet_map) for t in texts])
    blank = {c: "?" for c in range(128) if c not in m.alphabet}
    assert got.tolist() == [[naive_phrases(t.translate(blank), s) for s in samples.values()] for t in texts]


def test_segments_end_phrases(monkeypatch):
    m = model_of({"x": "abcdabcdabcd" * 4})
    whole = [language.symbols("abcd" * 8, m.alphabet_map)]
    assert m.phrases(whole).tolist() == [[1]]
    monkeypatch.setattr(language, "SEGMENT", 8)
    assert m.phrases(whole).tolist() == [[4]]


def test_held_out_accuracy(spark, sf_dir):
    out = language.op1(spark, sf_dir).alias("o").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(out) > 30
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edges(spark):
    docs = edge_docs(spark)
    out = language.identify(docs, language.learn(docs)).collect()
    assert len(out) == len(edge_rows())
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert und == {3, 4, 5, 6}
    assert {r["score"] for r in out if r["doc_id"] == 3} == {0.0}
    empty = docs.filter("false")
    assert language.identify(empty, language.learn(empty)).count() == 0
    nothing = language.identify(docs, language.learn(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_tie_goes_to_the_first_language():
    m = model_of({"a": "abab", "b": "abab"})
    lang, score, _ = m.judge(["ab"])[0]
    assert (lang, score) == ("a", pytest.approx(0.5))


def test_large_alphabets_and_long_texts_keep_their_letters(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = {lang: ["".join(map(chr, rng.integers(first, first + size, 2 if size > 99 else 5))) for _ in range(400)] for lang, first, size in (("ja", 0x4E00, 1500), ("ka", 0x10D0, 30), ("ko", 0xAC00, 900), ("ru", 0x430, 32), ("zh", 0x6000, 1500))}
    rows = [(10 * i + k, " ".join(rng.choice(words[lang], 3000 if lang == "ka" else 200)), lang, "s", 1) for i in range(20) for k, lang in enumerate(words)]
    docs = edge_docs(spark, rows)
    model = language.learn(docs)
    assert model.langs == sorted(words)  # texts of ka are all longer than a sampled part
    got = language.identify(docs, model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {r[0]: r[2] for r in rows}
    texts = [language.symbols(t[:500], model.alphabet_map) for _, t, *_ in rows[:10]]
    tables = model.phrases(texts)
    monkeypatch.setattr(language, "CELLS", 8_000_000)
    some = language.Model(model.langs, model.alphabet, model.edges, model.states, model.sizes)
    assert any(some.tabled) and not all(some.tabled)
    monkeypatch.setattr(language, "CELLS", 0)
    none = language.Model(model.langs, model.alphabet, model.edges, model.states, model.sizes)
    assert not any(none.tabled) and (none.phrases(texts) == tables).all() and (some.phrases(texts) == tables).all()
    kept = pipeline.identify_language(spark, docs, "")
    assert kept.count() == len(rows)


def test_letters_beyond_the_third_plane_and_short_languages(spark):
    short = [(100 + i, f"kwi zmo {i}", "xx", "s", 1) for i in range(50)]
    rows = [(i, "the cat and the dog went home in the rain again and again " * 2, "en", "s", 1) for i in range(20)] + short + [(200, chr(0x30001) * 20, None, "s", 1), (201, "zmo kwi kwi zmo", None, "s", 1), (202, "12 34", None, "s", 1)]
    docs = edge_docs(spark, rows)
    model = language.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert model.langs == ["en", "xx"] and got[200] != "und" and got[201] == "xx" and got[202] == "und"
