"""Substring deduplication: suffix automata of reference shards, matching statistics, maximal spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import mix64, pack, steps, store, table, unpack
from faultline.llm.words import runs, text_bytes, word_hashes, words

#: words of a window, words of the runs that route it, distinct segments of one shard that one automaton takes
WINDOW, ROUTE, SHARD = 13, 5, 20_000
STEP = 2_000_000
U = np.uint64
LAST = U(0xFFFFFFFFFFFFFFFF)


def routes(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, route: int = ROUTE) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, route) of the segments of each text, and its words (starts, ends, firsts).

    A window's route is the smallest hash among the runs of ``route`` words in it, so equal windows have equal routes
    wherever they stand. A segment is a longest row of windows, one word apart, that share their route.
    """
    starts, ends, firsts = words(data, bounds)
    h = word_hashes(data, starts, ends)
    short, at = runs(h, firsts, route)
    low = np.full(len(h) + 1, LAST)
    low[at] = short
    span, width = window - route + 1, 1
    while width < span:  # sliding minimum by doubling
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        width += step
    n = np.diff(firsts)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(low))
    inside = first < len(h)
    first = first[inside]
    first = first[first + window <= firsts[1:][owner[first]]]
    own, via = owner[first], low[first]
    new = np.ones(len(first), bool)
    new[1:] = (via[1:] != via[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    return own[begin], first[begin] - firsts[own[begin]], np.diff(np.append(begin, len(first))), via[begin], starts, ends, firsts


def repeated_spans(segments: list[tuple[int, list]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each segment of one shard, in order of document, the spans of windows (first, end) whose words also occur in
    a segment of a smaller document.

    One suffix automaton grows over the segments: those of a document are first streamed through the automaton of all
    smaller documents, which gives the longest match that ends at each word, and are added to it afterwards.
    """
    nxt: list[dict] = [{}]
    link, length = [-1], [0]
    out: list[list[tuple[int, int]]] = []

    def match(seg: list) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        state = n = 0
        for i, c in enumerate(seg):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            if n >= window:
                w = i - window + 1
                if spans and spans[-1][1] == w:
                    spans[-1] = (spans[-1][0], w + 1)
                else:
                    spans.append((w, w + 1))
        return spans

    def clone(q: int, n: int) -> int:
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(n)
        return len(nxt) - 1

    def add(seg: list) -> None:
        last = 0
        for c in seg:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                cur, p = len(nxt) - 1, last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
            else:
                cur, p = -1, last
            if q is not None:
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    new = clone(q, length[p] + 1)
                    link[q] = new
                    if cur >= 0:
                        link[cur] = new
                    else:
                        cur = new
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
            last = cur

    i = 0
    while i < len(segments):
        j = i
        while j < len(segments) and segments[j][0] == segments[i][0]:
            j += 1
        out += [match(seg) for _, seg in segments[i:j]]
        for _, seg in segments[i:j]:
            add(seg)
        i = j
    return out


def duplicate_spans(docs: DataFrame, window: int = WINDOW, route: int = ROUTE, shard: int = SHARD) -> DataFrame:
    """(id, spans) for (id, text): the words [first, end) of each document that lie in a window of ``window`` words which
    also starts in a document of smaller id. Documents without such words have no row. Ids are taken as unique.

    The reference is the corpus itself, so its automata cannot be broadcast; it is cut into shards by content instead and
    each shard's automaton is built where its segments meet. Windows are routed by `routes`; routes of one document
    only are dropped with a count that is pre-aggregated. What is left, segments of the others, is reduced to distinct
    ones with their first document: an occurrence in a later document is repeated as a whole, and only the first
    occurrences go through the automaton of their shard. Shards of more than ``shard`` distinct segments (a passage in very
    many surroundings) are split further, by single window, with a pre-aggregated minimum.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            own, _, _, via, *_ = routes(*text_bytes(b.column(1)), window, route)
            order = np.lexsort((via, own))
            own, via = own[order], via[order]
            new = np.ones(len(own), bool)
            new[1:] = (via[1:] != via[:-1]) | (own[1:] != own[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own[new])), pa.array(via[new].astype(np.int64))], ["id", "via"])

    seen = docs.mapInArrow(find, "id bigint, via bigint")
    common = seen.groupBy("via").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("via")
    wanted = seen.join(common, "via").groupBy("id").agg(F.collect_list("via").alias("vias"))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "packed", STEP // 3):
            data, bounds = text_bytes(pa.array(unpack(b.column(1)), pa.binary()))
            own, first, n, via, starts, ends, firsts = routes(data, bounds, window, route)
            vias = b.column(2)
            flat = vias.flatten().to_numpy().astype(U)
            owner = np.repeat(np.arange(b.num_rows), np.diff(vias.offsets.to_numpy()))
            ask = mix64(flat + mix64(owner.astype(U)))
            keep = np.isin(mix64(via + mix64(own.astype(U))), ask)
            own, first, n, via = own[keep], first[keep], n[keep], via[keep]
            a = starts[firsts[own] + first]
            z = ends[firsts[own] + first + n + window - 2]
            raw = data.tobytes()
            text = [b" ".join(raw[x:y].split()) for x, y in zip(a.tolist(), z.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(via.astype(np.int64)), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(text, pa.binary())], ["id", "via", "first", "n", "words"])

    texts = pack(docs).join(wanted, "id").select("id", "packed", "vias")
    found = store(texts.mapInArrow(segment, "id bigint, via bigint, first int, n int, words binary").withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit("second"), "words")}))
    distinct = store(found.groupBy("via", "h1", "h2").agg(F.min("id").alias("low")))
    sizes = distinct.groupBy("via").agg(F.count("*").alias("k")).filter("k > 1")
    # the first occurrence of each distinct segment whose route leads through other segments as well
    held = found.join(distinct.join(sizes, "via", "left"), ["via", "h1", "h2"])
    held = store(held.select("id", "via", "first", "n", "h1", "h2", "low", F.when((F.col("id") == F.col("low")) & (F.col("k") > 1), F.col("words")).alias("words"), "k"))
    later = held.filter("id > low").select("id", "first", F.expr(f"first + n + {window - 1}").alias("end"))
    firsts_ = held.filter("words IS NOT NULL")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> pa.RecordBatch:
            ids, at, to = [], [], []
            for i, (x, y) in enumerate(zip(rows, repeated_spans([(r[1], r[3].split(b" ")) for r in rows], window))):
                for p, q in y:
                    ids.append(x[1]), at.append(x[2] + p), to.append(x[2] + q + window - 1)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(to, pa.int32())], ["id", "first", "end"])

        group: list = []
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if group and group[0][0] != row[0]:
                    yield done(group)
                    group = []
                group.append(row)
        if group:
            yield done(group)

    ordered = firsts_.filter(f"k <= {shard}").select("via", "id", "first", "words").repartition("via").sortWithinPartitions("via", "id", "first")
    within = ordered.mapInArrow(stream, "id bigint, first int, end int")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, h1, h2 = [], [], [], []
            for i, first, seg in zip(*[b.column(k).to_pylist() for k in range(3)]):
                ws = seg.split(b" ")
                for p in range(len(ws) - window + 1):
                    d = hashlib.blake2b(b" ".join(ws[p : p + window]), digest_size=16).digest()
                    ids.append(i), at.append(first + p), h1.append(int.from_bytes(d[:8], "little", signed=True)), h2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["id", "first", "h1", "h2"])

    windows = firsts_.filter(f"k > {shard}").select("id", "first", "words").mapInArrow(single, "id bigint, first int, h1 bigint, h2 bigint")
    earliest = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"))
    apart = windows.join(earliest, ["h1", "h2"]).filter("id > low").select("id", "first", F.expr(f"CAST(first + {window} AS int)").alias("end"))
    spans = later.union(within).union(apart)
    return spans.groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_words, n_removed, kept) for (id, text) and (id, spans): the words that no span covers, joined by one space.

    A null text has no words. Rows of null id or of an id without spans keep all their words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "packed", STEP // 3):
            n, removed, kept = [], [], []
            for text, cuts in zip(unpack(b.column(1)), b.column(2).to_pylist()):
                ws = (text or b"").split()
                if cuts:
                    keep = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(keep, [c["first"] for c in cuts], 1)
                    np.add.at(keep, [c["end"] for c in cuts], -1)
                    keep = np.cumsum(keep)[:-1] == 0
                    left = [w for w, k in zip(ws, keep.tolist()) if k]
                else:
                    left = ws
                n.append(len(ws)), removed.append(len(ws) - len(left)), kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    joined = pack(docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))).join(spans, "id", "left").select("id", "packed", "spans")
    return joined.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that a window of ``window`` words repeats from a
    document with a smaller id; judged on the input, whatever else is removed.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D and stay unchanged. Null texts have no words; rows of
    null id keep all words and are no reference; repeated rows of one id are copies of one document and no reference
    for each other. Other columns are not read; an empty table gives an empty table.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return remove(own, duplicate_spans(own, window, **options)).withColumnRenamed("id", id_col)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
n AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p+12], ' ')) AS h FROM n),
f AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
r AS (SELECT DISTINCT doc_id, p + unnest(range(0, 13)) AS q FROM k JOIN f USING (h) WHERE doc_id > low),
q AS (SELECT doc_id, list(q) AS gone, count(*) AS n FROM r GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.q WHERE r.q IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(q.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN s USING (doc_id)"""

QUERIES = {"op2_substring_dedup": op2}
ORACLES = {"op2_substring_dedup": ORACLE}
