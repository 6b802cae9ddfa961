import hashlib
import random

import numpy as np
import pytest

from faultline.llm import fingerprints as fp
from helpers import edge_docs, edge_rows, prose


def test_gear_hash_and_cuts_against_definition():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 16, 17, 40, 3000):
        data = r.integers(0, 256 if n % 2 else 3, n).astype(np.uint8)
        want = [sum(int(fp.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % (1 << 16) for i in range(n)]
        assert fp.gear_hashes(data).tolist() == want
        ends, start = [], 0
        while start < n:
            size = 1
            while start + size < n:
                h = want[start + size - 1]
                bits = fp.STRICT if size < fp.NORMAL else fp.LOOSE
                if size >= fp.LEAST and (h >> (16 - bits) == (1 << bits) - 1 or size == fp.MOST):
                    break
                size += 1
            start += size
            ends.append(start)
        assert fp.cuts(data) == ends


def naive_print(text):
    raw = text.encode()
    out, a = {}, 0
    for e in fp.cuts(np.frombuffer(raw, np.uint8)):
        out[raw[a:e]] = out.get(raw[a:e], 0) + e - a
        a = e
    return out


def naive_like(a, b):
    a, b = naive_print(a), naive_print(b)
    return sum(min(w, b.get(c, 0)) for c, w in a.items()) / sum(a.values()) if a else float(not b)


def naive(rows, stands):
    """Rows in descending order of ids; ``stands`` is the text that stands for an id."""
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None] * any(i is None for i, _ in rows)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    out = []
    for i, t in rows:
        t = t or ""
        half, nxt = len(t) // 2, stands[after[i]]
        e = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), naive_like(t, e), naive_like(t, nxt)))
    return out


def digests(df):
    return sorted(map(str, ((r[0], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect())))


def test_edges_in_slots_of_any_size(spark, monkeypatch):
    rows = edge_rows()
    docs = edge_docs(spark, rows)
    stands = {i: t or "" for i, t, *_ in rows}
    want = sorted(map(str, naive([r[:2] for r in rows], stands)))
    for size in (20_000, 3, 1):
        monkeypatch.setattr(fp, "SLOT_ROWS", size)
        assert digests(fp.edits(docs)) == want
    assert fp.edits(docs.filter("false")).count() == 0 and fp.fingerprint(docs.filter("false")).count() == 0
    (one,) = fp.edits(docs.filter("doc_id = 1")).collect()
    t = rows[0][1]
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest()


def test_repeated_ids_share_one_place(spark):
    rows = [(1, prose(1), "en", "s", 1), (5, prose(2), "en", "s", 1), (5, prose(3), "en", "s", 1), (9, prose(4), "en", "s", 1)]
    got = digests(fp.edits(edge_docs(spark, rows)))
    assert got in [sorted(map(str, naive([r[:2] for r in rows], {1: rows[0][1], 9: rows[3][1], 5: t}))) for t in (rows[1][1], rows[2][1])]


def test_equal_texts_and_small_edits(spark):
    a = prose(1, 900, 5000)
    r = random.Random(2)
    words = a.split()
    b = " ".join(words[:300] + ["inserted"] + words[300:])
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1), (4, prose(7, 900, 5000), "en", "s", 1), (5, " ".join(r.sample(words, len(words))), "en", "s", 1)]
    got = {x["doc_id"]: x["fingerprint"] for x in fp.fingerprint(edge_docs(spark, rows)).collect()}
    assert got[1] == got[2] and fp.likeness(got[1], got[2]) == 1
    assert fp.likeness(got[1], got[3]) > 0.95 and fp.likeness(got[3], got[1]) > 0.95
    assert fp.likeness(got[1], got[4]) < 0.02 and fp.likeness(got[1], got[5]) < 0.1
    assert fp.likeness("", "") == 1 and fp.likeness("", got[1]) == 0 == fp.likeness(got[1], "")


def test_query(spark, sf_dir, documents, monkeypatch):
    monkeypatch.setattr(fp, "SLOT_ROWS", 23)
    rows = fp.op12(spark, sf_dir).collect()
    want = naive([d[:2] for d in documents], {d[0]: d[1] or "" for d in documents})
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows) == sorted(want)
    long = [r for r in rows if r["n_chars"] >= 400]
    assert np.mean([r["near_edited"] for r in long]) == pytest.approx(0.5, abs=0.05)
    assert np.mean([r["near_next"] for r in long]) < 0.1
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in rows}
