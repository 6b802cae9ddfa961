"""Embedding near-duplicates: an exact metric range join over pivot cells, split into tiles of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import cut, table
from faultline.llm.components import components, merge, tiles

#: distinct vectors for each pivot, the most pivots altogether (their table is broadcast), rows of a tile's side
PER_PIVOT, MAX_PIVOTS, TILE = 2_000, 4_096, 2_048


def usable(vec: str) -> str:
    """SQL: whether a vector can be compared: not null, no null or non-finite component, not zero."""
    return f"{vec} IS NOT NULL AND size({vec}) > 0 AND NOT exists({vec}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists({vec}, x -> x <> 0)"


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = np.asarray(col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten(), np.float64)
    m = flat.reshape(len(col), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def range_links(vectors: DataFrame, least: float = 0.93, per_pivot: int = PER_PIVOT, max_pivots: int = MAX_PIVOTS, tile: int = TILE) -> DataFrame:
    """(rep, root, n): for distinct vectors (rep, grp, weight, vec), all usable, one row for each tile in which a vector
    has links: the weights of the vectors it is linked with there (counted where the vector is at home), and one
    vector of the tile that it is connected with. Links are the pairs of one ``grp`` with cosine >= ``least``.

    Each vector lives in the cell of its nearest pivot. A link spans at most r = sqrt(2 - 2 least) between unit vectors, so
    by the triangle inequality it can only reach a cell whose pivot is at most 2r farther than the nearest one and whose
    outermost vector lies within d - r; the vector is copied to those cells. Cells of more than ``tile``
    vectors become tiles: every part of the cell's own vectors meets every part of all its vectors. Nothing is dropped;
    tiles hold 2 ``tile`` rows, however many vectors a group or cell has.
    """
    spark = vectors.sparkSession
    r = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    vectors = vectors.withColumn("grp", F.struct("grp", F.size("vec").alias("dim")))
    sizes = vectors.agg(F.count("*").alias("n")).first()
    wanted = min(max_pivots // 2, sizes["n"] // per_pivot)
    rate = int(wanted / max(sizes["n"], 1) * (1 << 40))
    # about `wanted` pivots by a hash of the id; twice as many would be far outside chance
    pivots = vectors.filter(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 40)) < rate).orderBy(F.xxhash64("rep", F.lit("pivot"))).limit(max_pivots).select(F.to_json("grp").alias("g"), "vec").collect() if rate else []
    by_group: dict[str, list[list[float]]] = {}
    for p in pivots:
        by_group.setdefault(p["g"], []).append(p["vec"])
    shared = spark.sparkContext.broadcast({g: _matrix(pa.array(v, pa.list_(pa.float64()))) for g, v in by_group.items()})

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row..., cell, dist): the nearest pivot of each vector."""
        for b in batches:
            groups = b.column(0).to_pylist()
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for g in set(groups):
                at = np.flatnonzero([x == g for x in groups])
                if g in shared.value:
                    d = _distances(_matrix(b.column(3).take(pa.array(at))), shared.value[g])
                    cell[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], [*b.schema.names, "cell", "dist"])

    rows = cut(vectors.select(F.to_json("grp").alias("g"), "rep", "weight", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(home, "g string, rep bigint, weight bigint, vec array<double>, cell int, dist double"))
    # one row for each cell: bounded by the pivots and the groups
    cells = rows.groupBy("g", "cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n"))
    reach = spark.sparkContext.broadcast({(c["g"], c["cell"]): c["radius"] for c in cells.filter(F.col("g").isin(list(by_group))).collect()} if by_group else {})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector at home and in every other cell that a link from it can reach."""
        for b in batches:
            groups, cell = b.column(0).to_pylist(), b.column(4).to_numpy()
            take, to, own = [np.arange(b.num_rows)], [cell], [np.ones(b.num_rows, bool)]
            for g in set(groups) & shared.value.keys():
                at = np.flatnonzero([x == g for x in groups])
                d = _distances(_matrix(b.column(3).take(pa.array(at))), shared.value[g])
                radius = np.array([reach.value.get((g, c), -10.0) for c in range(d.shape[1])])
                near = (d <= d.min(axis=1, keepdims=True) + 2 * r) & (d <= radius + r)
                near[np.arange(len(at)), cell[at]] = False
                i, c = np.nonzero(near)
                take.append(at[i]), to.append(c.astype(np.int32)), own.append(np.zeros(len(i), bool))
            out = b.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(np.concatenate(to)), pa.array(np.concatenate(own))], ["g", "id", "weight", "vec", "cell", "own"])

    spreaded = rows.mapInArrow(spread, "g string, id bigint, weight bigint, vec array<double>, cell int, own boolean")
    tiled = tiles(spreaded, ["g", "cell"], tile)

    def join(rows: pa.Table) -> pa.Table:
        rep, weight = rows["id"].to_numpy(), rows["weight"].to_numpy()
        asks, answers = rows["asks"].to_numpy(zero_copy_only=False).astype(bool), np.flatnonzero(rows["answers"].to_numpy(zero_copy_only=False).astype(bool))
        m = _matrix(rows["vec"])
        root, n = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        ask = np.flatnonzero(asks)
        for a in range(0, len(ask), 256):
            at = ask[a : a + 256]
            linked = m[at] @ m[answers].T >= least
            linked &= rep[at][:, None] != rep[answers][None, :]
            n[at] = linked @ weight[answers]
            for k in np.flatnonzero(linked.any(axis=1)):
                merge(root, at[k], answers[linked[k]])
        some = np.flatnonzero((n > 0) | (np.bincount(root, minlength=len(root))[root] > 1))
        return pa.table({"rep": rep[some], "root": rep[root[some]], "n": n[some]})

    return tiled.groupBy("g", "cell", "i", "j").applyInArrow(join, "rep bigint, root bigint, n bigint")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", **sizes: int) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row.

    Links join rows of one non-null label and one vector length with cosine >= ``least`` in double precision, copies of a vector
    included. n_links counts the other rows linked directly; component_id is the smallest id reachable, kept says
    whether it is the row's own. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, as do rows of null label or null id (kept false for a null id). Equal vectors are compared once, as
    one vector with a weight. Rows that repeat an id count as rows of their own and share a component if linked.
    """
    rows = vectors.selectExpr(f"`{id_col}` AS id", f"`{group_col}` AS grp", f"CAST(`{vec_col}` AS array<double>) AS vec")
    fit = rows.filter(f"id IS NOT NULL AND grp IS NOT NULL AND {usable('vec')}").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("second"), "vec")})
    same = cut(fit.groupBy("grp", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec")))
    found = cut(range_links(same.select("rep", "grp", "weight", "vec"), least, **sizes))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    groups = same.select("grp", "h1", "h2", "rep", "weight").join(linked, "rep", "left").join(reached, "rep", "left")
    keyed = fit.select("id", "grp", "h1", "h2").join(groups, ["grp", "h1", "h2"])
    out = keyed.select("id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.filter(f"NOT coalesce(id IS NOT NULL AND grp IS NOT NULL AND {usable('vec')}, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)"""

QUERIES = {"op6_embedding_near_dedup": op6}
ORACLES = {"op6_embedding_near_dedup": ORACLE}
