import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import spelling
from helpers import edge_docs, edge_rows, same_as_sql
from test_lines import distance


def naive_words(rows, shortest=5, rare=3):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= rare}


def naive(words, more=2):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and distance(v, w) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= more * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def random_words(seed, n, letters="abé", longest=9, shortest=2):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(shortest, longest))): r.choice((1, 2, 3, 5, 9, 9, 20, 41)) for _ in range(n)}


@pytest.mark.parametrize("known", [0, 1])
def test_scan_against_full_distance(known):
    for seed in range(8):
        words = sorted(("x" * known) + w for w in random_words(seed, 60, "ab" if seed % 2 else "abcd", 6, 1))
        block = np.repeat([1, 2], [len(words) // 2, len(words) - len(words) // 2])
        everyone = np.ones(len(words), bool)
        asks = np.arange(len(words)) % 3 != seed % 3 if seed > 3 else everyone
        answers = np.arange(len(words)) % 4 != seed % 4 if seed > 5 else everyone
        q, r = spelling.one_edit(words, block, np.full(len(words), known), asks, answers)
        want = {(x, y) for x in np.flatnonzero(asks) for y in np.flatnonzero(answers) if block[x] == block[y] and distance(words[x], words[y]) == 1}
        assert len(q) == len(want) and set(zip(q.tolist(), r.tolist())) == want


def test_variants_by_brute_force_in_tiles_and_steps(spark, monkeypatch):
    for seed, tile, rows in ((1, 8_192, 30_000), (2, 3, 7), (3, 8_192, 5)):
        monkeypatch.setattr(spelling, "TILE", tile)
        monkeypatch.setattr(spelling, "ROWS", rows)
        words = random_words(seed, 150)
        frame = spark.createDataFrame(list(words.items()), "word string, n long")
        assert got(spelling.variants(frame)) == naive(words)


def test_long_chain_of_forms(spark):
    words = {"a" * k: 2**k for k in range(2, 40)} | {"z" * 600: 4, "z" * 601: 9}
    assert got(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == naive(words)
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), more=1)


def test_edges(spark):
    rows = edge_rows() + [(50 + k, "Straße strasse STRASSE café CAFÉ ÀÉÎõü×÷ straße " + "q" * 40_000, "de", "s", 1) for k in range(200)]
    want = naive_words(rows)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(edge_docs(spark, rows)).collect()} == want
    assert any(len(w) in (39_999, 40_000) for w in want) and "straße" in want
    short = {w: n for w, n in want.items() if len(w) < 100}
    assert got(spelling.variants(spark.createDataFrame([*short.items(), (None, 3), ("nothing", None), ("", 3)], "word string, n long"))) == naive(short)
    assert spelling.variants(spelling.vocabulary(edge_docs(spark).filter("false"))).count() == 0


def test_query(spark, sf_dir, documents):
    same_as_sql(spark, sf_dir, "op13_spelling_variants", spelling.QUERIES, spelling.ORACLES)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()} == naive_words(documents)
