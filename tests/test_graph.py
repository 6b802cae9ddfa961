import hashlib
import json
import itertools
from collections import deque

import pytest
from pyspark.sql import functions as F

from faultline.operators import graphs as G, provenance as P, traces as T

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (7, 8), (2, 9), (9, 10), (1, 10)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_components(spark):
    cc = {r.id: r.component for r in G.connected_components(edges(spark)).collect()}
    assert all(cc[i] == 1 for i in (1, 2, 3, 4, 5, 9, 10)) and all(cc[i] == 6 for i in (6, 7, 8))
    sc = {r.id: r.component for r in G.strong_components(edges(spark)).collect()}
    assert sc[1] == sc[2] == sc[3] == 1 and sc[4] == sc[5] == 4 and sc[9] == 9 and len(sc) == 10


def test_long_chain_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert G.connected_components(df).select("component").distinct().count() == 1


def test_triangles_and_pagerank(spark):
    t = {r.id: r for r in G.triangles(edges(spark)).collect()}
    assert t[1].triangles == 1 and t[4].triangles == 0 and t[3].degree == 3 and abs(t[3].clustering - 1 / 3) < 1e-12
    ranks = [r.rank for r in G.pagerank(edges(spark)).collect()]
    assert abs(sum(ranks) - 1) < 1e-9 and len(ranks) == 10


def test_betweenness_matches_brute_force(spark):
    adj = {}
    for a, b in EDGES:
        adj.setdefault(a, []).append(b)
    nodes = sorted({x for e in EDGES for x in e})

    def paths(s):
        dist, count, order = {s: 0}, {s: 1}, deque([s])
        while order:
            v = order.popleft()
            for w in adj.get(v, []):
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        return dist, count

    info = {s: paths(s) for s in nodes}
    want = {v: 0.0 for v in nodes}
    for s, t, v in itertools.permutations(nodes, 3):
        (ds, cs), (dv, cv) = info[s], info[v]
        if t in ds and v in ds and t in dv and ds[v] + dv[t] == ds[t]:
            want[v] += cs[v] * cv[t] / cs[t]
    between, close = G.sampled_paths(edges(spark), G.nodes_of(edges(spark)))
    got = {r.id: r.betweenness for r in between.collect()}
    for v in nodes:
        assert abs(got.get(v, 0.0) - want[v]) < 1e-9
    c = {r.id: r.closeness for r in close.collect()}
    d1 = info[1][0]
    assert abs(c[1] - (len(d1) - 1) / sum(d1.values())) < 1e-12


def test_centrality_of_all_nodes(spark):
    """Against a search from every node; with too many nodes an estimate from a sample."""
    adj, nodes = {}, sorted({x for e in EDGES for x in e})
    for a, b in EDGES:
        adj.setdefault(a, set()).add(b)
    dist = {}
    for s in nodes:
        dist[s], level, d = {s: 0}, {s}, 0
        while level:
            d += 1
            level = {w for v in level for w in adj.get(v, ())} - dist[s].keys()
            dist[s] |= dict.fromkeys(level, d)
    n = len(nodes)
    got = {r.id: r for r in G.centrality(edges(spark)).collect()}
    assert got.keys() == set(nodes)
    summed = {r.id: r.betweenness for r in G.sampled_paths(edges(spark), G.nodes_of(edges(spark)))[0].collect()}
    for v in nodes:
        reach = [dist[s][v] for s in nodes if s != v and v in dist[s]]
        want = len(reach) / sum(reach) * len(reach) / (n - 1) if reach else 0.0
        assert got[v].exact and abs(got[v].closeness - want) < 1e-12
        assert abs(got[v].betweenness - summed.get(v, 0.0) / ((n - 1) * (n - 2))) < 1e-12
    rough = G.centrality(edges(spark), exact=n - 1, sample=n).collect()  # a sample of all nodes is the exact value
    assert all(not r.exact and r.closeness is None and abs(r.betweenness - got[r.id].betweenness) < 1e-12 for r in rough)
    assert G.centrality(edges(spark).where("false")).count() == 0
    assert {r.betweenness for r in G.centrality(edges(spark).limit(1)).collect()} == {0.0}


def test_merkle(spark):
    rows, want = [], {}
    for n in (1, 2, 3, 255, 256, 257, 700):
        level = [hashlib.sha256(f"{n}/{i}".encode()).hexdigest() for i in range(n)]
        rows += [(n, i, h) for i, h in enumerate(level)]
        while len(level) > 1:
            level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
        want[n] = level[0]
    df = spark.createDataFrame(rows, "batch long, i long, h string")
    assert {r.batch: r.merkle_root for r in T.merkle_roots(df, "batch", "i", "h").collect()} == want


def test_unconverged_loops_raise(spark):
    with pytest.raises(ArithmeticError):
        G.pagerank(edges(spark), 1e-15, iterations=2)


def test_proofs_of_more_than_one_run(spark):
    rows = [("a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(700)] + [("b", 0, "x"), ("c", 0, "p"), ("c", 1, "q"), ("c", 2, "r")]
    leaves = spark.createDataFrame(rows, "batch string, i long, h string")
    roots = {r.batch: r.merkle_root for r in T.merkle_roots(leaves, "batch", "i", "h").collect()}
    proofs = T.merkle_proofs(leaves, "batch", "i", "h").withColumn("ok", T.verify_proof(F.col("leaf"), F.col("proof"), F.col("root"))).collect()
    assert len(proofs) == len(rows)
    assert all(p.ok and p.root == roots[p.batch] for p in proofs)
    assert {len(p.proof) for p in proofs if p.batch == "a"} == {10}


def test_proofs_are_not_shuffled(spark):
    """A leaf's proof is made from its run, above the last exchange, whatever the number of rounds."""
    rows = [("a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(70_000)]
    proofs = T.merkle_proofs(spark.createDataFrame(rows, "batch string, i long, h string"), "batch", "i", "h")
    plan = proofs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")
    ends = proofs.select("i", F.size("proof").alias("steps"), T.proof_end(F.col("leaf"), F.col("proof")).alias("end"), "root").distinct().collect()
    assert len(ends) == 70_000 and {r.steps for r in ends} == {17} and len({r.end for r in ends} | {r.root for r in ends}) == 1


def test_path_eval(spark):
    paths = spark.createDataFrame([("x", [1, 2, 3, 4]), ("y", [6, 8]), ("z", [5, 9]), ("one", [1]), ("w", [1, 10, 9])], "attack string, nodes array<long>")
    got = {r.attack: r for r in P.path_eval(edges(spark), paths).collect()}
    assert got["x"].path == [1, 2, 3, 4] and got["x"].completeness == got["x"].ordering == 1
    assert got["y"].path == [6, 7, 8] and got["y"].completeness == 1
    assert not got["z"].found and not got["one"].found
    assert got["w"].path == [1, 2, 9] and abs(got["w"].completeness - 2 / 3) < 1e-9 and got["w"].ordering == 1


def node_rows(spark, rows):
    """(event_id, ts in seconds, function, raw JSON) as provenance nodes."""
    df = spark.createDataFrame([(i, s * 1_000_000, f, "benign", raw) for i, s, f, raw in rows], "event_id long, ts_us long, function_id string, anomaly_type string, raw string")
    zero = {c: F.lit(0.0) for c in ("network_io_bytes", "memory_spike_kb", "cpu_utilization")}
    return P.provenance_nodes(df.withColumns(zero), "raw")


def test_content_flows(spark, monkeypatch):
    raw = lambda i, o: json.dumps({k: v for k, v in (("payload", i), ("result", o)) if v is not None})
    hot = [(100 + i, 50 + i % 7, f"x{i}", raw("hot", "hot")) for i in range(40)]
    rows = [(1, 0, "aa", raw(None, {"k": 1})), (2, 10, "bb", raw({"k": 1}, "z")), (3, 400, "cc", raw({"k": 1}, None)), (4, 10, "dd", raw("external z", None)), (5, 10, "ee", raw("z", {"k": 1})), (6, 20, "ff", None), *hot]
    time = {i: s for i, s, *_ in rows}
    ins, outs = ({i: json.loads(r).get(k) for i, _, _, r in rows if r} for k in ("payload", "result"))
    want = {(a, b) for a, x in outs.items() for b, y in ins.items() if x is not None and x == y and (time[a], a) < (time[b], b) and time[b] - time[a] <= 300}
    for crowded in (5_000, 3):
        monkeypatch.setattr(P, "CROWDED", crowded)
        nodes = node_rows(spark, rows)
        assert {tuple(r) for r in P.flow_pairs(nodes, 300_000_000).collect()} == want
    assert {(1, 2), (2, 5)} <= want and len(want) > 600
    e = {(r.src, r.dst): r.type for r in P.causal_edges(nodes, ["function_id"], across=True).collect()}
    assert e[1, 2] == "derivation" and all(t == "derivation" for t in e.values())
    assert {(r.event_id, r.predecessor) for r in P.predecessors(nodes, ["function_id"]).where("event_id < 100").collect()} == {(2, 1), (5, 2)}
    assert [r.vectors for r in nodes.where("event_id = 4").collect()] == [["external_input"]]


def test_long_attack_chain_is_found_whole(spark):
    chain = [(i, i + 1, 0.8 if i % 2 else 0.5, 0.6) for i in range(1, 13)]  # twelve ancestors of 13
    wide = [(100 + i, 200, 0.5, 0.5) for i in range(30)] + [(300, 100 + i, 0.5, 0.5) for i in range(30)]  # one level of thirty ends the search
    e = spark.createDataFrame(chain + wide + [(13, 5, 0.9, 0.1)], "src long, dst long, strength double, confidence double")  # and a circle
    ids = [*range(1, 14), *range(100, 130), 200, 300, 400]
    n = spark.createDataFrame([(i, i, "f", "benign" if i > 2 else "error", "security_event" if i < 3 else "data_input", ["network"] if i == 4 else []) for i in ids],
                              "event_id long, ts_us long, function_id string, anomaly_type string, node_type string, resources array<string>")
    got = {r.target: r for r in P.attack_paths(e, n.where("event_id IN (13, 200, 400)"), n).collect()}
    assert (got[13].nodes, got[13].hops, got[13].entry_point, got[13].attack_type) == (13, 12, 1, "multi_stage")
    assert abs(got[13].severity - 1.0) < 1e-9 and abs(got[13].confidence - 0.6) < 1e-9 and got[13].anomalous == 2
    assert [x.id for x in got[13].timeline] == list(range(1, 14))
    assert [(m.control, m.id) for m in got[13].mitigation][:3] == [("input validation", 3), ("input validation", 4), ("resource access control", 4)]
    assert (got[200].nodes, got[200].hops) == (31, 1) and (got[400].nodes, got[400].attack_type, got[400].confidence) == (1, "simple", 0.0)
