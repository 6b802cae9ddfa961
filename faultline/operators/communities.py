"""Communities of high modularity by contraction: groups merge where modularity gains, single nodes then move, until neither helps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators.graphs import nodes_of, undirected
from faultline.session import stored

EPS = 1e-9


def _coin(c: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 1


def _links(edges: DataFrame) -> DataFrame:
    """(x, y, w): every link in both directions."""
    u = undirected(edges)
    return u.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))).withColumn("w", F.lit(1.0))


def _quality(links: DataFrame, lab: DataFrame, m2: float) -> float:
    """Modularity of (id, c)."""
    j = links.join(lab.select(F.col("id").alias("x"), F.col("c").alias("cx")), "x").join(lab.select(F.col("id").alias("y"), F.col("c").alias("cy")), "y")
    per = j.groupBy("cx").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cx") == F.col("cy"), F.col("w")).otherwise(0.0)).alias("i"))
    return per.agg(F.sum(F.col("i") / m2 - F.pow(F.col("k") / m2, 2))).first()[0] or 0.0


def _accepted(asks: DataFrame, m2: float) -> DataFrame:
    """(x, to, kx, ky): the groups a hub may take together, so that each still gains after those before it.

    The one with the largest gain comes first, the others by powers of two of the degree they bear beside them, a whole power
    at a time: sums per (hub, power) are all that a hub needs, however many ask.
    """
    lead = asks.groupBy("to").agg(F.min(F.struct("o", "x")).alias("m")).select("to", F.col("m.x").alias("lead"))
    a = asks.join(lead, "to").withColumn("room", F.col("w") * m2 / F.col("kx") - F.col("ky"))
    a = a.withColumn("power", F.when(F.col("x") == F.col("lead"), 2000).otherwise(F.floor(F.log2("room"))).cast("int"))
    sums = a.groupBy("to", "power").agg(F.sum("kx").alias("s")).withColumn("through", F.sum("s").over(W.partitionBy("to").orderBy(F.desc("power"))))
    return a.join(sums.drop("s"), ["to", "power"]).where((F.col("x") == F.col("lead")) | (F.col("room") > F.col("through") - F.col("kx"))).select("x", "to", "kx", "ky")


def merged(links: DataFrame, m2: float, turn: int) -> DataFrame | None:
    """(x, to, kx, ky): merges of one turn, all of them together a gain; None where no two groups gain by merging.

    A group asks the neighbour it gains most with. Of two that ask each other the smaller one takes, and so does no group that asks
    a taker; the others draw who asks and who takes. Nobody does both, and all mutual pairs merge, so a turn is never empty.
    """
    g = links.withColumn("o", F.col("kx") * F.col("ky") / m2 - F.col("w")).where(F.col("o") < -EPS)
    best = stored(g.groupBy("x").agg(F.min(F.struct("o", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), F.col("y").alias("to"), "w", "kx", "ky")).alias("m")).select("x", "m.o", "m.to", "m.w", "m.kx", "m.ky"))
    if best.isEmpty():
        return None
    roots = best.join(best.select(F.col("x").alias("to"), F.col("to").alias("x")), ["x", "to"]).where("x < to").select("x")
    drawn = best.join(roots.withColumn("root", F.lit(True)), "x", "left").join(roots.select(F.col("x").alias("to"), F.lit(True).alias("near")), "to", "left")
    drawn = drawn.withColumn("asks", F.when(F.col("root"), False).when(F.col("near"), True).otherwise(_coin("x", turn)))
    takers = drawn.where("NOT asks").select(F.col("x").alias("to"))
    return stored(_accepted(drawn.where("asks").join(takers, "to"), m2))


def _weighed(links: DataFrame, degree: DataFrame) -> DataFrame:
    """Links between groups (x, y, w) with the degree sums of both ends."""
    k = degree.select(F.col("id").alias("x"), F.col("k").alias("kx"))
    return links.join(k, "x").join(k.select(F.col("x").alias("y"), F.col("kx").alias("ky")), "y").select("x", "y", "w", "kx", "ky")


def _relabelled(links: DataFrame, to: DataFrame) -> DataFrame:
    """Links (x, y, w, kx, ky) between the groups named by ``to`` (c, n, k); those it does not name stay."""
    j = links.join(to.select(F.col("c").alias("x"), F.col("n").alias("nx"), F.col("k").alias("nkx")), "x", "left").join(
        to.select(F.col("c").alias("y"), F.col("n").alias("ny"), F.col("k").alias("nky")), "y", "left")
    j = j.select(F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "w", F.coalesce("nkx", "kx").alias("kx"), F.coalesce("nky", "ky").alias("ky"))
    return j.where("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w"), F.max("kx").alias("kx"), F.max("ky").alias("ky"))


def _moved(links: DataFrame, degree: DataFrame, lab: DataFrame, m2: float, turn: int) -> DataFrame:
    """(id, c) after the nodes that drew heads went where they gain most; staying wins ties."""
    own = degree.join(lab, "id")
    tot = own.groupBy("c").agg(F.sum("k").alias("t"))
    near = links.where(_coin("x", turn)).join(lab.select(F.col("id").alias("y"), "c"), "y").select(F.col("x").alias("id"), "c", "w").unionAll(
        own.where(_coin("id", turn)).select("id", "c", F.lit(0.0))).groupBy("id", "c").agg(F.sum("w").alias("w"))
    near = near.join(own.select("id", "k", F.col("c").alias("was")), "id").join(tot, "c")
    gain = F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("was"), F.col("k")).otherwise(0.0)) / m2
    best = near.groupBy("id").agg(F.min(F.struct(F.round(-gain, 9).alias("o"), (F.col("c") != F.col("was")).alias("away"), "c")).alias("m")).select("id", F.col("m.c").alias("to"))
    return lab.join(best, "id", "left").select("id", F.coalesce("to", "c").alias("c"))


def communities(edges: DataFrame) -> DataFrame:
    """(id, community), the community named by its smallest node; links count once, loops not at all.

    Groups merge turn by turn, each turn raising modularity, until no merge gains; then nodes move between groups, a sweep being
    kept only if modularity rose. Both repeat until modularity stops rising, so there is no number of rounds to choose.
    """
    base = stored(_links(edges))
    degree = stored(base.groupBy(F.col("x").alias("id")).agg(F.sum("w").alias("k")))
    m2 = float(base.agg(F.sum("w")).first()[0] or 1.0)
    lab = stored(nodes_of(edges).select("id", F.col("id").alias("c")))
    best, turns = _quality(base, lab, m2), count(1)
    while True:
        start = best
        sums = lab.join(degree, "id").groupBy("c").agg(F.sum("k").alias("k"))
        here = stored(_relabelled(_weighed(base, degree), lab.join(sums, "c").select(F.col("id").alias("c"), F.col("c").alias("n"), "k")))
        while (take := merged(here, m2, next(turns))) is not None:
            hubs = take.groupBy("to").agg((F.max("ky") + F.sum("kx")).alias("k"))
            here = stored(_relabelled(here, take.select(F.col("x").alias("c"), "to").unionAll(hubs.select("to", "to")).join(hubs, "to").select("c", F.col("to").alias("n"), "k")))
            lab = stored(lab.join(take.select(F.col("x").alias("c"), "to"), "c", "left").select("id", F.coalesce("to", "c").alias("c")))
        best, failed = _quality(base, lab, m2), 0
        while failed < 2:  # one sweep of either half
            turn = next(turns)
            new = stored(_moved(base, degree, lab, m2, turn))
            q = _quality(base, new, m2)
            failed = 0 if q > best + EPS else failed + 1
            if not failed:
                lab, best = new, q
        if best <= start + EPS:
            break
    name = lab.groupBy("c").agg(F.min("id").alias("community"))
    return lab.join(name, "c").select("id", "community")


def community_report(members: DataFrame) -> DataFrame:
    """(community, size, anomalous): a community of one node, or of more than three times the mean size, is anomalous."""
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    mean = size.agg(F.avg("size").alias("_m"))
    return size.crossJoin(F.broadcast(mean)).select("community", "size", F.expr("size = 1 OR size > 3 * _m").alias("anomalous"))  # one row
