"""Line deduplication: a segment-partition edit join with length-aware substring keys and a banded check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import steps, store, table
from faultline.llm.components import bucket_components, semi

#: edits between two lines that count as one, and the characters from which lines may differ by that many; shorter ones by fewer
EDITS, SHORTEST = 2, 24
#: occurrences from which a line loses all but the first
LEAST = 2


def line_id(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def allowed(length: int, edits: int, shortest: int) -> int:
    """Edits that a line of this length may be from a line at least as long: in proportion below ``shortest`` (2 from 24 characters on, 1 from 12, else 0)."""
    return edits if length >= shortest else length * edits // shortest


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line: equal sizes, the longer ones last."""
    parts = edits + 1
    small, longer = divmod(length, parts)
    sizes = [small] * (parts - longer) + [small + 1] * longer
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def keys(line: str, edits: int) -> list[int]:
    """Keys under which a line meets every line at most ``edits`` edits away.

    A line is indexed under its own edits + 1 segments, one of which an equal-or-longer near line must hold unchanged. It
    probes the segments of every length from its own down by ``edits``: with as many characters deleted, segment i
    can only start where i edits before it and edits - i behind it allow. A key hashes length, segment number and characters.
    """
    raw, n = line.encode("utf-32-le", "surrogatepass"), len(line)
    out = []
    for length in range(n, max(n - edits, edits + 1) - 1, -1):
        shift = n - length
        for i, (start, size) in enumerate(segments(length, edits)):
            low = max(start - i, start + shift - (edits - i), 0)
            high = min(start + i, start + shift + (edits - i), n - size)
            for p in range(low, high + 1):
                out.append(xxhash.xxh3_64_intdigest(raw[4 * p : 4 * (p + size)], length * (edits + 1) + i) - (1 << 63))
    return out


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair is at most ``edits`` insertions, deletions and substitutions apart.

    Equal ends are trimmed. Then all pairs run side by side, one character of the first line at a time: for each number
    of edits e a word holds one bit for each diagonal of the band, set where the prefixes are at most e edits apart.
    """
    ok = np.zeros(len(pairs), bool)
    codes = []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > edits:
            continue
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        n = min(len(x), len(y))
        head = int(np.argmax(np.append(x[:n] != y[:n], True)))
        x, y, n = x[head:], y[head:], n - head
        tail = int(np.argmax(np.append(x[len(x) - n :][::-1] != y[len(y) - n :][::-1], True)))
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if len(x) and len(y):
            codes.append((k, x, y))
        else:
            ok[k] = max(len(x), len(y)) <= edits
    codes.sort(key=lambda c: -len(c[1]))
    a = 0
    while a < len(codes):  # lanes of about a million cells, longest first
        z = a + max(1, min(4096, 1_000_000 // len(codes[a][1])))
        ok[[c[0] for c in codes[a:z]]] = _band(codes[a:z], edits)
        a = z
    return ok


def _band(codes: list[tuple[int, np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    width, n = 2 * edits + 1, np.array([len(c[1]) for c in codes])
    s = np.full((n[0], len(codes)), 0x110001, np.uint32)
    t = np.full((n[0] + width + edits, len(codes)), 0x110002, np.uint32)
    for k, (_, x, y) in enumerate(codes):
        s[: len(x), k] = x
        t[edits : edits + len(y), k] = y
    full = np.uint64((1 << width) - 1)
    # bit d + edits stands for the diagonal d; with nothing read, d characters of the second line cost d edits
    state = [np.full(len(codes), sum(1 << (d + edits) for d in range(e + 1)), np.uint64) for e in range(edits + 1)]
    done = np.zeros(len(codes), bool)
    goal = np.uint64(1) << (np.array([len(c[2]) - len(c[1]) for c in codes]) + edits).astype(np.uint64)
    one = np.uint64(1)
    for i in range(n[0]):
        k = int(np.searchsorted(-n, -i, side="left"))
        match = np.zeros(k, np.uint64)
        for d in range(width):
            match |= (s[i, :k] == t[i + d, :k]).astype(np.uint64) << np.uint64(d)
        before = None
        new = []
        for e in range(edits + 1):
            own = state[e][:k] & match
            if before is not None:
                own = own | before | (before >> one) | ((new[e - 1] << one) & full)
            before = state[e][:k].copy()
            new.append(own)
        for e in range(edits + 1):
            state[e][:k] = new[e]
        if i % 32 == 31 and not state[edits][:k].any():
            break
    done = (state[edits] & goal) != 0
    return done


def matches(texts: list[str], asks: np.ndarray, answers: np.ndarray, edits: int, shortest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking line the other answering lines that are near enough; lengths and characters are compared first."""
    size = np.array([len(t) for t in texts])
    sums = np.zeros((len(texts), 64), np.int32)  # how often each character (of 64 classes) occurs: two for each edit at most
    for i, t in enumerate(texts):
        sums[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
    for a in asks:
        near = answers[(np.abs(size[answers] - size[a]) <= edits) & (answers != a)]
        near = near[np.abs(sums[near] - sums[a]).sum(axis=1) <= 2 * edits]
        ok = near_pairs([(texts[a], texts[b]) for b in near], edits, shortest) if len(near) else np.zeros(0, bool)
        if ok.any():
            yield int(a), near[ok]


def line_keys(line: str, edits: int, shortest: int) -> list[int]:
    """Keys under which a line meets every longer or shorter line that is as near as the shorter one's length allows."""
    n = len(line)
    most = allowed(n, edits, shortest)
    # shorter lines it can meet may allow fewer edits than it does itself
    return [k for e in range(1, most + 1) if any(allowed(m, edits, shortest) == e for m in range(max(n - e, 0), n + 1)) for k in keys(line, e)]


def near_pairs(pairs: list[tuple[str, str]], edits: int, shortest: int) -> np.ndarray:
    """Whether each pair is as near as the length of its shorter line allows."""
    most = np.array([allowed(min(len(a), len(b)), edits, shortest) for a, b in pairs], int)
    ok = np.zeros(len(pairs), bool)
    for e in range(1, edits + 1):
        at = np.flatnonzero(most == e)
        if len(at):
            ok[at] = within([pairs[k] for k in at], e)
    return ok


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, no, line) of every line that is not blank: its number in the text and its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            ids, nos, lines = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for no, line in enumerate(text.split("\n")):
                    if line.strip():
                        ids.append(i), nos.append(no), lines.append(line_id(line))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(lines, pa.int64())], ["id", "no", "line"])

    return docs.mapInArrow(run, "id bigint, no int, line bigint")


def near_lines(docs: DataFrame, edits: int, shortest: int) -> DataFrame:
    """(id, component) of the lines (by hash) that have a different line as near as the shorter one's length allows."""
    some = next((n for n in range(shortest + 1) if allowed(n, edits, shortest)), shortest)  # shorter lines are linked by equality only

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            distinct = {line for text in b.column(1).to_pylist() for line in text.split("\n") if len(line) >= some and line.strip()}
            found = [(line_id(line), line_keys(line, edits, shortest)) for line in distinct]
            n = [len(f[1]) for f in found]
            key = np.fromiter((k for f in found for k in f[1]), np.int64, sum(n))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(np.array([f[0] for f in found], np.int64), n))], ["key", "id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            distinct = list({line for text in b.column(1).to_pylist() for line in text.split("\n") if len(line) >= some and line.strip()})
            yield pa.RecordBatch.from_arrays([pa.array([line_id(x) for x in distinct], pa.int64()), pa.array(distinct, pa.string())], ["id", "text"])

    # copies of a line have met within a step; what is left of a key is its different lines
    rows = docs.mapInArrow(probe, "key bigint, id bigint")
    met = rows.select("*", F.min("id").over(_by_key()).alias("low"), F.max("id").over(_by_key()).alias("high")).filter("low < high")
    buckets = store(met.select("key", "id").distinct())
    wanted = store(buckets.select("id").distinct())
    texts = store(semi(docs.mapInArrow(read, "id bigint, text string"), wanted, ["id"]).groupBy("id").agg(F.first("text").alias("text")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text_b"):
            linked = near_pairs(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist())), edits, shortest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], ["a", "b", "linked"])

    def verified(pairs: DataFrame) -> DataFrame:
        held = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return held.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint, linked boolean")

    return bucket_components(buckets, texts, verified, lambda *rows: matches(*rows, edits, shortest))


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key")


def removals(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(id, gone): the numbers of the lines to remove from each document (id, text) that has any, as `deduplicate` does."""
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    near = near_lines(docs, edits, shortest)
    each = occurrences(docs).join(near.select(F.col("id").alias("line"), "component"), "line", "left").select("id", "no", F.coalesce("component", "line").alias("line"))
    each = store(each)
    first = each.groupBy("line").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("n")).filter(f"n >= {least}").select("line", "first")
    return each.join(first, "line").filter("struct(id, no) <> first").groupBy("id").agg(F.collect_set("no").alias("gone"))


def origins(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(id, origin, gone): like `removals`, apart for each document ``origin`` that holds the first occurrences of the lines removed."""
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    near = near_lines(docs, edits, shortest).select(F.col("id").alias("line"), "component")
    each = store(occurrences(docs).join(near, "line", "left").select("id", "no", F.coalesce("component", "line").alias("line")))
    first = each.groupBy("line").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("n")).filter(f"n >= {least}").select("line", "first")
    return each.join(first, "line").filter("struct(id, no) <> first").groupBy("id", F.col("first.id").alias("origin")).agg(F.collect_set("no").alias("gone"))


def deduplicate(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept), one row per row: each text without the lines that repeat an earlier line.

    Lines are split at newlines. Lines that are equal, or at most ``edits`` character edits apart, are linked; below ``shortest``
    characters the edits shrink with the shorter line's length (`allowed`), down to equality alone. Of each connected class with
    ``least`` occurrences the first by (doc_id, line number) stays; rarer classes and blank lines always stay.
    Kept lines are joined by newlines. A null text has no lines and an empty kept text, an empty text one empty line; rows of null id
    keep everything and are no reference; rows that repeat an id count as one document whose rows lose the same lines. Other columns
    are not read; an empty table gives an empty table.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    joined = own.join(removals(own, edits, shortest, least), "id", "left").select("id", lines.alias("lines"), gone.alias("gone"))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    out = joined.withColumn("kept", kept).select("id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept"))
    return out.withColumnRenamed("id", id_col)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3}
ORACLES: dict[str, str] = {}
