"""Connected components of a link table, and of candidates that meet in buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import cut, store


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of the links (a, b) the smallest id it can reach.

    Large-star and small-star steps in turn, each one grouped minimum: every node tells its neighbours the smallest node
    it knows. A node's neighbours are never gathered: the minimum is pre-aggregated before the shuffle, so a hub of
    any size costs one row per task, and its links are then joined as rows (adaptive joins split them). Links shrink
    towards stars; the loop ends when a round changes nothing. Each round is checkpointed. Null ends are ignored.
    """
    edges = cut(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: the larger neighbours of a node hang on the smallest node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("x"), "m").filter("x <> m")
        small = cut(moved.select(F.col("x").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def tiles(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """``rows`` with ``own`` (whether a row asks), dealt out so that in every group each asking row meets every row.

    Adds i, j, asks, answers: a group of more than ``tile`` rows is split into parts, and part i's asking rows meet part j's rows
    in tile (i, j). A tile holds about two parts, however large its group is; within it, asks and answers say which role a row
    has. A row stands once in a tile.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.ceil(F.col("__n") / tile).cast("int").alias("parts"))
    placed = rows.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"))
    seq = F.sequence(F.lit(0), F.col("parts") - 1)
    answering = F.transform(seq, lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), (F.col("own") & (i == F.col("part"))).alias("asks"), F.lit(True).alias("answers")))
    asking = F.transform(F.filter(seq, lambda j: j != F.col("part")), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers")))
    return placed.select(*rows.columns, F.inline(F.concat(answering, F.when(F.col("own"), asking).otherwise(F.array()))))


def merge(root: np.ndarray, a: int, others: np.ndarray) -> None:
    """Joins the classes of ``a`` and ``others`` in ``root``, the class of each element."""
    ends = np.unique(root[np.append(others, a)])
    if len(ends) > 1:
        root[np.isin(root, ends)] = ends[0]


Matcher = Callable[[list[str], np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]


def bucket_components(buckets: DataFrame, texts: DataFrame, verified: Callable[[DataFrame], DataFrame], matches: Matcher, tile: int = 1_024) -> DataFrame:
    """(id, component) of the ids that have a link, for buckets (key, id) and texts (id, text).

    Candidates are the pairs of a bucket. First every id is checked against the smallest one of its bucket by ``verified``,
    which turns pairs (a, b) into (a, b, linked): n copies cost n checks. The ids that are then still apart from their
    bucket's smallest one join the group of its component, where ``matches`` holds them against all ids of the group, a tile at
    a time: (texts, asking rows, answering rows) to (asking row, linked rows). So each candidate is checked exactly
    or connected otherwise, and no pair becomes a row unless it is one of the first kind.
    """
    ends = buckets.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    buckets = store(buckets.join(ends, "key"))
    star = store(verified(buckets.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()).filter("linked").select("a", "b"))
    at = components(star)
    hubs = at.select(F.col("id").alias("first"), F.col("component").alias("hub"))
    placed = buckets.filter("n > 2").join(at, "id", "left").join(hubs, "first", "left")
    placed = placed.select("key", "id", F.coalesce("component", "id").alias("component"), F.coalesce("hub", "first").alias("hub"))
    split = placed.filter("component <> hub").select("key").distinct()
    rows = store(placed.join(split, "key", "left_semi").select("hub", "id", (F.col("component") != F.col("hub")).alias("own")).distinct())
    tiled = tiles(rows, ["hub"], tile).join(texts, "id")

    def join(group: pa.Table) -> pa.Table:
        ids, own = group["id"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False).astype(bool)
        root = np.arange(len(ids))
        for a, others in matches(group["text"].to_pylist(), np.flatnonzero(own), np.flatnonzero(group["answers"].to_numpy(zero_copy_only=False).astype(bool))):
            merge(root, a, others)
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[root[some]], "b": ids[some]})

    more = tiled.groupBy("hub", "i", "j").applyInArrow(join, "a bigint, b bigint")
    return components(star.union(more))


def semi(df: DataFrame, ids: DataFrame, on: list[str], rows: int = 400_000) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (a stored table): broadcast if it counts at most ``rows``, else shuffled."""
    return df.join(F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids, on, "left_semi")
