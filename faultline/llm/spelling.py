"""Spelling variant grouping: words one edit apart, found over sorted lists with shared rows of a banded edit matrix."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import small_batches, steps, store, table
from faultline.llm.components import tiles

#: what a word is made of
RUN = "[A-Za-zÀ-ÿ]+"
#: one of this many occurrences of a run loses a character, chosen by its hash
NOISE = 97
#: code points and occurrences of a word at least, and how much more frequent than a word its form must be
SHORTEST, RARE, MORE = 5, 3, 2
#: words of a block that one list holds, and rows that are worked on at a time
TILE, ROWS = 8_192, 30_000
#: different words that a task counts before it passes the counts on
COUNTED = 300_000
DEAD = 9


def document_words(doc_id: int | None, text: str, noise: int = NOISE) -> Counter:
    """The words of one text with their counts: runs of letters, A-Z lower-cased, one character deleted where the run's hash says so.

    The hash knows the document and the run only, so each different run of a document is hashed once.
    """
    runs = Counter(re.findall(RUN, text.encode().lower().decode()))  # bytes.lower() changes A-Z only
    out: Counter = Counter()
    head = f"{'' if doc_id is None else doc_id}:"
    for run, n in runs.items():
        h = zlib.crc32((head + run).encode())
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rare: int = RARE, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points that occur ``rare`` times or more in all texts. A null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in steps(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in document_words(i, text, noise).items():
                    if len(word) >= shortest:
                        counts[word] += n
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(f"n >= {rare}")


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words end to end, where each word starts, and how long it is."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return flat, np.cumsum(size) - size, size


def shared_prefixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, block: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each word of a sorted list how many code points it shares with the word before it in its block; -1 for a block's first one."""
    lcp = np.full(len(size), -1, np.int64)
    at = np.flatnonzero(block[1:] == block[:-1]) + 1
    d = known[at].copy()
    while len(at):
        more = d < np.minimum(size[at], size[at - 1])
        more[more] = flat[start[at[more]] + d[more]] == flat[start[at[more] - 1] + d[more]]
        lcp[at[~more]] = d[~more]
        at, d = at[more], d[more] + 1
    return lcp


def one_edit(words: list[str], block: np.ndarray, known: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, answering word) of all pairs of different words of one block that are one edit apart.

    Words are sorted within blocks, and a block's words share their first ``known`` characters. All asking words scan the answering list of
    their block together, one character further each time. A state is an asking word, a range of the list whose words share a prefix,
    and the band of that prefix's row of the edit matrix (three cells: the asking word's prefix is one shorter, as long, one longer). A
    range splits where adjacent words share no more than the prefix; each part takes the next row from the row of
    the whole range, and is skipped if no cell of it is at most one edit.
    """
    flat, start, size = codes(words)
    row = np.flatnonzero(answers)
    lcp = shared_prefixes(flat, start[row], size[row], block[row], known[row])
    order = np.argsort(lcp, kind="stable")
    depth_of = lcp[order]
    query = np.flatnonzero(asks)
    low, high = np.searchsorted(block[row], block[query], side="left"), np.searchsorted(block[row], block[query], side="right")
    query, low, high = query[high > low], low[high > low], high[high > low]
    waiting = np.argsort(known[query], kind="stable")
    query, low, high = query[waiting], low[waiting], high[waiting]
    depths = known[query]
    q, a, z = (np.zeros(0, np.int64) for _ in range(3))
    band = np.zeros((3, 0), np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    d = int(depths[0]) if len(depths) else 0
    entered = 0
    while entered < len(query) or len(q):
        now = int(np.searchsorted(depths, d, side="right"))
        if now > entered:  # an equal prefix: no edit on the diagonal, one beside it
            new = slice(entered, now)
            first = np.array([[1 if d else DEAD], [0], [1]], np.uint8)
            q, a, z = np.append(q, query[new]), np.append(a, low[new]), np.append(z, high[new])
            band = np.concatenate([band, np.repeat(first, now - entered, axis=1)], axis=1)
            entered = now
        # the shortest word of a range may end here
        ended = size[row[a]] == d
        k = size[q] - d + 1
        near = ended & (k >= 0) & (k <= 2)
        near[near] = band[k[near], np.flatnonzero(near)] == 1
        found.append((q[near], row[a[near]]))
        a = a + ended
        left = a < z
        q, a, z, band = q[left], a[left], z[left], band[:, left]
        # split the ranges at the words that share no more than the prefix
        splits = np.sort(order[np.searchsorted(depth_of, d, side="left") : np.searchsorted(depth_of, d, side="right")])
        s, e = np.searchsorted(splits, a + 1), np.searchsorted(splits, z)
        parts = e - s + 1
        of = np.repeat(np.arange(len(q)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        padded = np.append(splits, 0)
        begin = np.where(nth == 0, a[of], padded[np.maximum(s[of] + nth - 1, 0)])
        end = np.where(nth == parts[of] - 1, z[of], padded[np.minimum(s[of] + nth, len(splits))])
        q, a, z, band = q[of], begin, end, band[:, of]
        # the next row of the band for the part's next character
        c = flat[start[row[a]] + d]
        n = size[q]
        new = np.full((3, len(q)), DEAD, np.uint8)
        for k in range(3):
            j = d + k  # characters of the asking word read in this cell, its last one being j - 1
            inside = (j >= 1) & (j <= n)
            if d == 0 and k == 0:  # nothing read yet: the first character of the list's word is deleted
                new[0] = np.minimum(band[1] + 1, DEAD)
                continue
            own = flat[np.minimum(start[q] + max(j - 1, 0), len(flat) - 1)]
            cost = band[k] + (own != c)
            if k < 2:
                cost = np.minimum(cost, band[k + 1] + 1)
            if k > 0:
                cost = np.minimum(cost, new[k - 1] + 1)
            new[k] = np.where(inside, np.minimum(cost, DEAD), DEAD)
        left = new.min(axis=0, initial=DEAD) <= 1
        q, a, z, band = q[left], a[left], z[left], new[:, left]
        d = d + 1 if len(q) else int(depths[entered]) if entered < len(query) else d + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def blocks(words: DataFrame) -> DataFrame:
    """(key, known, back, sorted, word, n, own): the blocks in which words of one edit meet.

    Take two words that are one edit apart, the shorter one of length m. Without the edit in its first m div 2 characters
    both start with these; otherwise both end with the other m - m div 2. So a word of length m is under its first and its last
    part as a word of length m (own) and, as the longer one of a pair, as of length m - 1. Blocks of last parts hold the
    words backwards.
    """
    kinds = []
    for own, m in ((True, "char_length(word)"), (False, "char_length(word) - 1")):
        kinds.append(f"struct(concat('f', {m}, ' ', substring(word, 1, ({m}) div 2)) AS key, ({m}) div 2 AS known, false AS back, word AS sorted, {str(own).lower()} AS own)")
        kinds.append(f"struct(concat('b', {m}, ' ', right(word, ({m}) - ({m}) div 2)) AS key, ({m}) - ({m}) div 2 AS known, true AS back, reverse(word) AS sorted, {str(own).lower()} AS own)")
    return words.select("word", "n", F.expr(f"inline(array({', '.join(kinds)}))")).withColumn("known", F.col("known").cast("long"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): for each word (word, n) that has near words their number and the most frequent one (of equals the smallest).

    Blocks are dealt by key and read as sorted streams, about ROWS rows at a time; a block of more than TILE words is split into parts
    which meet in tiles. Within a block only pairs one edit apart come up, and of those each task passes on one row per word.
    """
    rows = blocks(words).withColumn("id", F.col("word"))
    dealt = tiles(rows, ["key"], TILE).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sorted")
    dealt = dealt.select("key", "i", "j", "known", "back", "own", "asks", "answers", "word", "sorted", "n")

    def search(t: pa.Table) -> pa.RecordBatch:
        word, sorted_words = t["word"].to_pylist(), t["sorted"].to_pylist()
        block, known, n = t["block"].to_numpy(), t["known"].to_numpy(), t["n"].to_numpy()
        back, own, asks, answers = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("back", "own", "asks", "answers"))
        q, r = one_edit(sorted_words, block, known, asks & own, answers)
        # words that also start alike have met in their block of first parts
        seen = np.fromiter((back[x] and word[x][: len(word[x]) // 2] == word[y][: len(word[x]) // 2] for x, y in zip(q.tolist(), r.tolist())), bool, len(q))
        q, r = q[~seen], r[~seen]
        longer = ~own[r]  # a longer word does not ask in this block, so the shorter one tells it
        target, other = np.append(q, r[longer]), np.append(r, q[longer])
        names, rank = np.unique(np.array(word, object), return_inverse=True)  # in code-point order; a word may stand in several blocks
        target, other, n = rank[target], rank[other], n[np.unique(rank, return_index=True)[1]]
        at = np.lexsort((other, -n[other], target))
        target, other = target[at], other[at]
        first = np.flatnonzero(np.diff(target, prepend=-1))
        count = np.diff(np.append(first, len(target)))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[target[first]], pa.string()), pa.array(count, pa.int64()), pa.array(n[other[first]], pa.int64()), pa.array(names[other[first]], pa.string())], ["word", "n_near", "form_n", "form"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held.append(t)
            rows += len(t)
            if rows >= ROWS:
                t = numbered(pa.concat_tables(held))
                last = int(np.searchsorted(t["block"].to_numpy(), t["block"][-1].as_py()))  # the last block may go on
                if last:
                    yield search(t.slice(0, last))
                held = [t.slice(last).drop_columns("block")]
                rows = len(t) - last
        if rows:
            yield search(numbered(pa.concat_tables(held)))

    part = dealt.mapInArrow(run, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), "best.form")


def numbered(t: pa.Table) -> pa.Table:
    """The table with the number of its block (key, i, j) in each row; rows of a block stand together."""
    key, i, j = t["key"].combine_chunks(), t["i"].to_numpy(), t["j"].to_numpy()
    new = np.ones(len(t), bool)
    import pyarrow.compute as pc

    new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False).astype(bool) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return t.append_column("block", pa.array(np.cumsum(new)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the last word reached by following forms.

    Each round joins every pointer with the pointer of its target, which doubles its reach, and writes the table. Counts grow from
    form to form, so there is no circle; it ends when no target has a form.
    """
    at = store(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = store(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, more: int = MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of (word, n), whose words are distinct.

    Words are near if exactly one inserted, deleted or replaced code point tells them apart. A word's form is its near word of largest n,
    of equals the smallest in code-point order, if that n is at least ``more`` (over 1) times its own; else form and form_n are null.
    root is the end of its forms. Null words, words of null n and words of fewer than two code points are left out; an empty table gives an empty table.
    """
    if more <= 1:
        raise ValueError("a form must be more frequent than its word, or forms could go in circles")
    words = store(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).filter("char_length(word) > 1 AND n IS NOT NULL"))
    near = near_words(words)
    good = F.col("form_n") >= F.lit(more) * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")
    )
    told = store(told)
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: CRC-32 over the bytes of a text, by a table of 256 remainders; near words by their deletions
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM r),
b AS (SELECT run, n, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM x),
e AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, y: xor(c // 256, crc.t[1 + xor(c % 256, y)])), 4294967295) AS h FROM b, crc),
w AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM e GROUP BY 1 HAVING len(word) >= 5 AND sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON rest = w.word),
f AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY v.n DESC, near) AS form, max(v.n) AS form_n FROM p JOIN w v ON v.word = near GROUP BY p.word),
g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.at AS root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word JOIN g l ON l.word = c.at AND l.form IS NULL"""

QUERIES = {"op13_spelling_variants": op13}
ORACLES = {"op13_spelling_variants": ORACLE}
