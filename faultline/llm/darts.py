"""Near-duplicate documents: weighted minhash by darts, banded candidates, exact check, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import mix64, steps, store, table
from faultline.llm.components import bucket_components, semi
from faultline.llm.words import runs, text_bytes, word_hashes, words

#: words of a shingle, bands, coordinates of a band: a pair of similarity 0.8 misses all bands with probability 7e-5
SHINGLE, BANDS, ROWS = 5, 24, 5
LEAST = 0.8
STEP = 2_000_000
U, MASK = np.uint64, (1 << 64) - 1


def shingles(col: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of the distinct word shingles of each text, in that order.

    Words are split at ASCII white space, with ASCII letters in lower case. A text of fewer words than a shingle has one
    shingle of all its words; a text without words has none.
    """
    data, bounds = text_bytes(col)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, firsts = words(data, bounds)
    h = word_hashes(data, starts, ends)
    got, at = runs(h, firsts, length)
    doc = np.searchsorted(firsts, at, side="right") - 1
    n = np.diff(firsts)
    for d in np.flatnonzero((n > 0) & (n < length)):
        x = np.array([n[d]], U)
        for w in h[firsts[d] : firsts[d + 1]]:
            x = mix64(x * U(0x100000001B3) + w)
        got, doc = np.append(got, x), np.append(doc, d)
    order = np.lexsort((got, doc))
    got, doc = got[order], doc[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], got[first], np.diff(np.append(first, len(got)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of k coordinates for each text, whether the text has any weight).

    Every element owns a half line of weight, cut into the regions [0, 1), [1, 2), [2, 4), [4, 8), ... Hashes of (element,
    region) throw darts into each region at random ranks (a Poisson process: as many as the region is wide for each
    unit of rank), each at a random weight and for a random coordinate. A dart counts for a text if its weight lies
    below the element's weight there; the earliest dart of a coordinate is the text's value. Two texts agree in a
    coordinate with the probability of their weighted Jaccard similarity. Only ranks up to a bound are thrown that leaves about
    k ln k darts for a text of any length; texts with a coordinate left empty go on with twice the bound.
    """
    total = np.bincount(owner, weights=weight, minlength=texts)
    sig, some = np.zeros((texts, k), U), total > 0
    todo, bound = np.flatnonzero(some), k * (math.log(k) + 3)
    while len(todo):
        position = np.full(texts, -1)
        position[todo] = np.arange(len(todo))
        mine = position[owner] >= 0
        own, el, w = position[owner[mine]], element[mine], weight[mine].astype(np.float64)
        limit = bound / total[todo]
        best, value = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, U)
        region, low, width = 0, 0.0, 1.0
        while len(own):
            seed = mix64(el + U(region * 0x9E3779B97F4A7C15 & MASK))
            o, lim, ww, rank, n = own, limit[own], w, np.zeros(len(own)), 0
            while len(o):
                n += 1
                dart = mix64(seed + U(n * 0xD1B54A32D192ED03 & MASK))
                rank = rank - np.log(_unit(dart)) / width
                live = rank < lim
                seed, o, lim, ww, rank, dart = seed[live], o[live], lim[live], ww[live], rank[live], dart[live]
                place = mix64(dart ^ U(0x5851F42D4C957F2D))
                hit = low + width * _unit(place) <= ww
                key = o[hit] * k + (mix64(place) % U(k)).astype(np.int64)[hit]
                r, v = rank[hit], dart[hit]
                np.minimum.at(best, key, r)
                first = best[key] == r
                value[key[first]] = v[first]
            region, low, width = region + 1, 1.0 if region == 0 else low * 2, 1.0 if region == 0 else width * 2
            more = w > low
            own, el, w = own[more], el[more], w[more]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        sig[todo[full]] = value.reshape(-1, k)[full]
        todo, bound = todo[~full], bound * 2
    return sig, some


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of a signature."""
    keys = np.repeat(np.arange(bands, dtype=U)[None, :] + U(1), len(sig), axis=0)
    for r in range(rows):
        keys = mix64(keys * U(0x100000001B3) + sig[:, r::rows][:, :bands])
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted elements, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(a[0]) and len(b[0]) else 0.0


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, length: int = SHINGLE) -> DataFrame:
    """(id, h1, h2, size, keys) for (id, text): two hashes of the text, the sum of the weights, the keys of the bands.

    A text without words has size 0 and no keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            owner, element, weight = shingles(b.column(1), length)
            sig, some = signatures(owner, element, weight, b.num_rows, bands * rows)
            keys = band_keys(sig[some], bands, rows).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
            size = np.bincount(owner, weights=weight, minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(size), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel()))], ["id", "h1", "h2", "size", "keys"])

    hashed = docs.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    return hashed.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, size bigint, keys array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, least: float, length: int = SHINGLE) -> DataFrame:
    """(a, b, linked) for candidate pairs (a, b) and (id, text): whether the exact weighted similarity reaches ``least``.

    A pair carries one text through the shuffle, the text of ``a`` joins it there; runs of one ``a`` are parsed once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in steps(batches, "text_b", STEP):
            owner, element, weight = shingles(b.column(3), length)
            bounds = np.searchsorted(owner, np.arange(b.num_rows + 1))
            linked = []
            for i, a in enumerate(b.column(0).to_pylist()):
                if a != last or own is None:
                    last, own = a, shingles(b.column(2).slice(i, 1), length)[1:]
                linked.append(similarity(own, (element[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]])) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    carried = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    joined = carried.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, linked boolean")


def matches(texts: list[str], asks: np.ndarray, answers: np.ndarray, least: float, length: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking text the answering ones of weighted similarity >= ``least``, from an inverted index of shingles."""
    owner, element, weight = shingles(pa.array(texts, pa.string()), length)
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)  # a shingle that occurs n times is n elements
    owner, element = np.repeat(owner, weight), mix64(np.repeat(element, weight) + copy.astype(U) * U(0x9E3779B97F4A7C15))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    size = np.diff(bounds)
    known, number = np.unique(element, return_inverse=True)
    order = np.argsort(number, kind="stable")
    first = np.searchsorted(number[order], np.arange(len(known) + 1))
    holder = owner[order]
    answering = np.zeros(len(texts), bool)
    answering[answers] = True
    for a in asks:
        mine = number[bounds[a] : bounds[a + 1]]
        n = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holder[at], minlength=len(texts))
        ok = answering & (both > 0) & (both >= least * (size[a] + size - both))
        ok[a] = False
        if ok.any():
            yield int(a), np.flatnonzero(ok)


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, length: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id), one row per row: the smallest id among the documents connected by near-duplicate links.

    A link joins two documents with equal texts of at least one word, or with weighted Jaccard similarity of their
    ``length``-word shingles (weight: how often a shingle occurs) >= ``least`` that meet in the bucket of a band. Documents
    without words (null, empty, white space) are classes of their own, as are rows of null id (null class). Rows that
    repeat an id share its class if their texts do.
    """
    rows_ = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS id", f"CAST(`{text_col}` AS string) AS text")
    known = rows_.filter("id IS NOT NULL")
    base = store(sketch(known, bands, rows, length))
    same = store(base.filter("size > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    member = same.select("rep", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    buckets = store(member.join(shared, "key").select("key", F.col("rep").alias("id")))
    # texts of the documents that meet another one anywhere
    wanted = store(buckets.select("id").distinct())
    texts = store(semi(known, wanted, ["id"]).withColumn("h1", F.xxhash64("text")).join(same.select(F.col("rep").alias("id"), "h1"), ["id", "h1"], "left_semi").groupBy("id").agg(F.first("text").alias("text")))
    at = bucket_components(buckets, texts, lambda pairs: verified(pairs, texts, least, length), lambda *rows: matches(*rows, least, length))
    reps = same.select("h1", "h2", "rep").join(at.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("class_id"))
    out = base.select("id", "h1", "h2", "size").join(reps, ["h1", "h2"], "left").select("id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
    return out.union(rows_.filter("id IS NULL").select("id", "id")).select(F.col("id").alias(id_col), "class_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`classes` with kept: whether the row's id is its class's; rows of null id are kept, as nothing is known of them."""
    id_col = options.get("id_col", "doc_id")
    return classes(docs, **options).withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_near_dedup": op4}
ORACLES: dict[str, str] = {}
