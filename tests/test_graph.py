"""Graph operators on small shapes with known answers, and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import blocks, finance, graph, hypotheses, matching, measures, network, relational, rules, structure

EDGES = "case_id long, src string, dst string, rel_type string, created_at timestamp_ntz, confidence double"


def make(spark, pairs, extra=()):
    e = spark.createDataFrame([(1, a, b, "t", None, 1.0) for a, b in pairs], EDGES)
    nodes = sorted({x for p in pairs for x in p} | set(extra))
    return spark.createDataFrame([(1, n) for n in nodes], "case_id long, entity_id string"), e


def by(df, value):
    return {r["entity_id"]: r[value] for r in df.collect()}


def test_degrees(spark):
    v, e = make(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")], ["z"])
    got = {r["entity_id"]: (r["degree"], r["in_degree"], r["out_degree"]) for r in graph.degrees(v, e).collect()}
    assert got == {"a": (1, 0, 2), "b": (2, 2, 1), "c": (1, 1, 0), "z": (0, 0, 0)}


def test_components(spark):
    v, e = make(spark, [("a", "b"), ("b", "c"), ("y", "x"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(30)]], ["q"])
    got = by(graph.components(v, e), "component")
    assert got["c"] == "a" and got["y"] == "x" and got["q"] == "q" and got["n30"] == "n00"


def brute_structure(nodes, edges):
    """Cut vertices, separated pairs, betweenness and closeness by searching the graph without each vertex and by counting paths."""
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def reach(s, gone=None):
        dist, todo = {s: 0}, [s]
        for v in todo:
            for w in near[v]:
                if w != gone and w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        return dist

    dist, out = {v: reach(v) for v in nodes}, {}

    def count(s, t):
        return 1 if s == t else sum(count(s, v) for v in near[t] if dist[s].get(v) == dist[s][t] - 1)

    for v in nodes:
        pieces = {frozenset(reach(w, v)) for w in near[v]}
        apart = sum(len(p) * len(q) for p, q in itertools.combinations(pieces, 2))
        between = sum(count(s, v) * count(v, t) / count(s, t) for s, t in itertools.combinations(nodes, 2) if v not in (s, t) and t in dist[s] and v in dist[s] and dist[s][v] + dist[v][t] == dist[s][t])
        n = len(nodes)
        out[v] = (len(pieces) > 1, apart / (n * (n - 1) / 2), between, sum(1 / d for w, d in dist[v].items() if w != v) / (n - 1))
    return out


def test_structure(spark):
    rnd = random.Random(2)
    nodes = [f"v{i:02}" for i in range(22)]
    pairs = [tuple(rnd.sample(nodes[:12], 2)) for _ in range(15)] + [tuple(rnd.sample(nodes[11:20], 2)) for _ in range(9)] + [("v00", "v00")]
    v, e = make(spark, pairs, nodes)
    want = brute_structure(nodes, pairs)
    got = {r["entity_id"]: (r["cut_vertex"], r["bridge_score"]) for r in blocks.cut_structure(v, e).collect()}
    assert {k: (c, pytest.approx(s)) for k, (c, s, *_) in want.items()} == got
    got = {r["entity_id"]: (r["betweenness"], r["closeness"]) for r in structure.centrality(v, e).collect()}
    assert {k: (pytest.approx(b), pytest.approx(c)) for k, (*_, b, c) in want.items()} == got


def test_sampled_centrality(spark):
    """The sum over about half of the sources comes near that over all of them."""
    rnd = random.Random(4)
    nodes = [f"r{i:03}" for i in range(150)]
    v, e = make(spark, [(n, rnd.choice(nodes[:10])) for n in nodes for _ in range(4)], nodes)
    rows = structure.centrality(v, e, exact=10, pivots=75).collect()
    assert not any(r["exact"] for r in rows)
    true = structure.centrality(v, e).collect()
    total = [sum(r[c] for r in x) for x in (rows, true) for c in ("betweenness", "closeness")]
    assert total[0] == pytest.approx(total[2], rel=0.2) and total[1] == pytest.approx(total[3], rel=0.2)


@pytest.mark.parametrize("seed", range(3))
def test_structure_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"{rnd.randrange(10**6):06d}" for _ in range(60)]
    pairs = [tuple(rnd.sample(nodes[:25], 2)) for _ in range(34)] + [tuple(rnd.sample(nodes[22:50], 2)) for _ in range(24 + 8 * seed)]
    pairs += [(nodes[50], x) for x in nodes[51:58]] + [(nodes[51], nodes[52])]
    ring = [f"ring{i:02}" for i in range(20)]
    pairs += [*zip(ring, [*ring[1:], ring[0]]), (ring[3], nodes[0]), (ring[3], ring[12])]
    v, e = make(spark, pairs, [*nodes, *ring])
    got = {r["entity_id"]: (r["cut_vertex"], r["bridge_score"]) for r in blocks.cut_structure(v, e).collect()}
    near = {x: {b for p in pairs for a, b in (p, p[::-1]) if a == x and b != x} for x in {*nodes, *ring}}

    def reach(s, gone):
        seen, todo = {s}, [s]
        for x in todo:
            new = near[x] - seen - {gone}
            seen |= new
            todo += new
        return frozenset(seen)

    for x in near:
        pieces = {reach(w, x) for w in near[x]}
        apart = sum(len(p) * len(q) for p, q in itertools.combinations(pieces, 2))
        assert got[x] == (len(pieces) > 1, pytest.approx(apart / (len(near) * (len(near) - 1) / 2))), x
    label = by(graph.components(v, e), "component")
    assert label == {x: min(reach(x, None)) for x in near}


def test_long_chains_in_few_rounds(spark, monkeypatch):
    """A chain, a ring and a star: far fewer rounds than vertices."""
    n, rounds, keep = 2000, [], graph.cut
    for m in (graph, blocks):
        monkeypatch.setattr(m, "cut", lambda df: rounds.append(1) or keep(df))
    names = lambda x: [f"{x}{i * 7919 % n:05d}" for i in range(n)]
    chain, ring = names("c"), names("r")
    v, e = make(spark, [*zip(chain, chain[1:]), *zip(ring, [*ring[1:], ring[0]]), *((f"s{i}", "hub") for i in range(500))])
    got = {r["entity_id"]: (r["cut_vertex"], r["bridge_score"]) for r in blocks.cut_structure(v, e).collect()}
    all_ = len(got) * (len(got) - 1) / 2
    assert all(got[x][0] == (0 < i < n - 1) and got[x][1] == pytest.approx(i * (n - 1 - i) / all_) for i, x in enumerate(chain))
    assert not any(got[x][0] for x in ring) and got["hub"][0] and not got["s3"][0] and got["hub"][1] == pytest.approx(500 * 499 / 2 / all_)
    assert len(rounds) < 65, len(rounds)


def test_known_shapes(spark):
    got = by(blocks.cut_structure(*make(spark, [*[("hub", f"x{i}") for i in range(4)], ("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "r"), ("r", "s")], ["alone"])), "cut_vertex")
    assert {k for k, c in got.items() if c} == {"hub", "q", "r"}


@pytest.mark.parametrize("leak", [False, True])
def test_pagerank(spark, leak):
    v, e = make(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert all(x == pytest.approx(1 / 3) for x in by(graph.pagerank(v, e, rounds=8, leak=leak), "pagerank").values())
    v, e = make(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c")])
    assert (sum(by(graph.pagerank(v, e, rounds=8, leak=leak), "pagerank").values()) < 0.99) == leak


def test_triangles_and_neighbours(spark):
    v, e = make(spark, [("a", "b"), ("c", "b"), ("a", "c"), ("c", "d")])
    assert [tuple(r)[1:] for r in graph.triangles(e).collect()] == [("a", "b", "c")]
    assert {tuple(r)[1:] for r in graph.common_neighbours(e, v).collect()} == {("a", "d", 1), ("b", "d", 1)}


def test_paths(spark):
    v, e = make(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")])
    got = {(r["target"], r["length"], "".join(r["path"])) for r in graph.shortest_paths(e, v.where("entity_id = 'a'"), 3).collect()}
    assert got == {("b", 1, "ab"), ("c", 1, "ac"), ("d", 2, "abd"), ("d", 2, "acd"), ("e", 3, "abde"), ("e", 3, "acde")}
    trace = {("".join(r["path"]), r["end_state"]) for r in graph.simple_paths(e, v.where("entity_id = 'a'"), 2).collect()}
    assert trace == {("abd", "depth_limit"), ("acd", "depth_limit")}
    trace = {("".join(r["path"]), r["end_state"]) for r in graph.simple_paths(e, v.where("entity_id = 'c'"), 4).collect()}
    assert trace == {("cde", "dead_end")}
    near = by(graph.harmonic_closeness(v, e, v.where("entity_id = 'a'"), 3), "closeness")
    assert near["a"] == pytest.approx((1 + 1 + 1 / 2 + 1 / 3) / 4)


def test_communities(spark):
    cliques = [(x + str(i), x + str(j)) for x in "pq" for i in range(4) for j in range(i)]
    v, e = make(spark, [*cliques, ("p0", "q0")], ["z"])
    got = by(structure.communities(v, e), "community")
    assert {got[f"p{i}"] for i in range(4)} == {"p0"} and {got[f"q{i}"] for i in range(4)} == {"q0"} and got["z"] == "z"
    assert set(by(structure.communities(v, e, exact=3), "community").values()) == {"p0", "z"}
    s = {r["community"]: r for r in structure.community_summary(structure.communities(v, e), v.withColumn("entity_type", F.substring("entity_id", 1, 1)), e).collect()}
    assert (s["p0"]["size"], s["p0"]["internal"], s["p0"]["external"], s["p0"]["density"], s["p0"]["top_types"]) == (4, 6, 1, 1.0, ["p"])

    def modularity(label):
        m, edges = len(cliques) + 1, [*cliques, ("p0", "q0")]
        deg = {k: sum(k in x for x in edges) for k in label}
        return sum(label[a] == label[b] for a, b in edges) / m - sum((sum(deg[k] for k in label if label[k] == c) / (2 * m)) ** 2 for c in set(label.values()))

    assert modularity(got) > modularity({k: "one" for k in got}) and modularity(got) > modularity({k: k for k in got})


def test_patterns(spark):
    v, e = make(spark, [("p", "f1"), ("q", "f1"), ("r", "f1"), ("p", "f2"), ("q", "f2"), *[("hub", f"leaf{i:02}") for i in range(10)]])
    deg = graph.degrees(v, e)
    ids = spark.createDataFrame([(1, "f1"), (1, "f2")], "case_id long, entity_id string")
    assert [(r["entity_id"], r["severity"]) for r in network.shared_identifiers(deg, ids).collect()] == [("f1", "MEDIUM")]
    assert [r["entity_id"] for r in network.concentration(deg).collect()] == ["hub"]
    links = hypotheses.missing_links(e.where("dst like 'f%'"), v.where("entity_id in ('p', 'q', 'r')"), v.withColumn("community", F.lit("c"))).collect()
    assert {(r["a"], r["b"]): (r["shared"], r["severity"]) for r in links} == {("p", "q"): (2, "MEDIUM"), ("p", "r"): (1, "LOW"), ("q", "r"): (1, "LOW")}
    assert {r["score"] for r in links if r["shared"] == 2} == {1.0}


def test_expansion(spark):
    rows = [(1, "a", "b", "t", "2024-01-01 00:00:00", 1.0), (1, "a", "c", "t", "2024-01-01 02:00:00", 1.0), (1, "b", "c", "t", "2024-01-01 00:30:00", 1.0)]
    e = spark.createDataFrame(rows, EDGES.replace("timestamp_ntz", "string")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert by(network.rapid_expansion(e), "seconds") == {"a": 7200, "c": 5400}


def test_priorities(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0, 1.0, 1.0, 3, 0, 0, 3), ("y", 0.0, 0.0, 0.0, 0.0, 0, 1, 0, 0)], "id string, prominence double, influence double, bridging double, reach double, high int, medium int, low int, hypotheses int")
    assert {r["id"]: (r["priority_score"], r["priority_tier"]) for r in network.priorities(df).collect()} == {"x": (1.0, "CRITICAL"), "y": (0.0375, "LOW")}


FACTS = "record_id string, case_id long, amount decimal(18,2), currency string, ref string, account string, party string, occurred_at timestamp_ntz"


def test_money(spark):
    rows = [("1", 1, "10.00", "INR", "R1", "A", "p", None), ("2", 1, "10.00", "INR", "R1", "A", "p", None), ("3", 1, "7.50", "INR", "R2", "B", "p", None), ("4", 1, "8.50", "INR", "R2", "B", "p", None), ("5", 1, "6000.00", None, None, "B", "q", None)]
    df = spark.createDataFrame([(a, b, *r) for a, b, *r in rows], FACTS.replace("decimal(18,2)", "string").replace("timestamp_ntz", "string")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r["currency"]: r for r in finance.currency_buckets(df, "case_id").collect()}
    assert (got["INR"]["n"], got["INR"]["groups"], got["INR"]["conflicting"]) == (4, 2, 1)
    assert str(got["INR"]["total_records"]) == "36.00" and str(got["INR"]["total_distinct"]) == "10.00"
    assert got[None]["n"] == 1 and str(got[None]["total_distinct"]) == "6000.00"
    assert [(r["amount"], r["n"]) for r in finance.duplicate_amounts(df, "case_id").collect()] == [("10.00", 2)]
    assert [r["n"] for r in finance.over_threshold(df, "case_id").collect()] == [1]
    assert finance.coverage(df, "case_id").first()["without_currency"] == 1


def test_bursts(spark):
    df = spark.createDataFrame([("u", s) for s in (0, 600, 1300, 1400, 1500, 1900)] + [("v", 5)], "k string, s long")
    assert [tuple(r) for r in rules.bursts(df, "k", "s", 600, 4).collect()] == [("u", 1300, 4)]
    assert rules.bursts(df, "k", "s", 600, 5).count() == 0


def test_hash_status(spark):
    h = "a" * 64
    df = spark.createDataFrame([(h, h.upper()), (h, "b" * 64), (None, h), (h, None), (h, "abc")], "a string, b string")
    assert [r[0] for r in df.select(rules.hash_status(F.col("a"), F.col("b"))).collect()] == ["match", "mismatch", "missing_source", "missing_expected", "unsupported"]


def test_ratio_and_proposals(spark):
    df = spark.createDataFrame([("priya sharma", "pryia sharma"), ("", ""), ("a", None), ("abc", "xyz"), ("x" * 70 + "ab", "x" * 70 + "ba")], "a string, b string")
    got = [r[0] for r in df.select(matching.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(91.6667, abs=1e-3) and got[1] == 100 and got[2] is None and got[3] == 0 and got[4] == pytest.approx(200 * 71 / 144)
    e = spark.createDataFrame([("1", "person", "priya sharma"), ("2", "person", "pryia sharma"), ("3", "person", "priya sharma"), ("4", "person", "paul shadow")], "entity_id string, entity_type string, canonical_value string")
    assert {tuple(r) for r in matching.proposals(e).collect()} == {("1", "2", 91.67, "ambiguous"), ("1", "3", 100.0, "strong")}


def test_structured_and_merged(spark):
    m = spark.createDataFrame([("r", "person", "p1", 0), ("r", "phone", "f1", 0), ("r", "phone", "f2", 0), ("r", "person", "p2", 0)], "record_id string, kind string, id string, pos int")
    got = {(r["src"], r["dst"], r["rel_type"]) for r in matching.structured_relationships(m).collect()}
    assert got == {("p1", "f1", "called"), ("p1", "f2", "called"), ("p2", "f1", "called"), ("p2", "f2", "called"), ("f1", "f2", "called")}
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c")], "src string, dst string")
    into = spark.createDataFrame([("c", "a")], "src string, into string")
    assert [tuple(r) for r in matching.merged(e, into).collect()] == [("a", "b")]


def test_relational(spark):
    cases = spark.createDataFrame([(1, "u"), (2, "w"), (3, "w")], "case_id long, owner_id string")
    members = spark.createDataFrame([(2, "u"), (2, "u"), (3, "x")], "case_id long, user_id string")
    assert {r["case_id"] for r in relational.visible(cases, members, "u").collect()} == {1, 2}
    assert relational.visible(cases, members, "u", admin=True).count() == 3
    c = spark.createDataFrame([(1, [1, 2]), (2, [1, 3]), (3, [])], "id long, sides array<long>")
    assert [r["id"] for r in relational.all_sides_visible(c, "sides", cases.where("case_id < 3").select("case_id"), "id").collect()] == [1]
    new = spark.createDataFrame([(1, "n"), (9, "n"), (9, "m")], "id long, v string")
    old = spark.createDataFrame([(1, "o")], "id long, v string")
    assert {tuple(r) for r in relational.appended(new, old, ["id"]).collect()} == {(1, "o"), (9, "m")}
    got = relational.bounded(spark.range(5), ["id"], 3).collect()
    assert [tuple(r) for r in got] == [(0, True), (1, True), (2, True)]
    raw = spark.createDataFrame([('{"a": 1, "b": {"c": "x", "d": true}, "e": [1], "f": null, "g": false}',)], "raw string")
    assert raw.select(relational.flattened(F.col("raw"))).first()[0] == {"a": "1", "b.c": "x"}
    like = spark.createDataFrame([("50%_off",), ("500 off",)], "v string")
    assert like.where(relational.escaped_like("v", "0%_O")).count() == 1
    steps = spark.createDataFrame([("open", "closed"), ("closed", "open"), ("open", "open")], "old string, new string")
    assert {(r["old"], r["new"]): r["legal"] for r in rules.legal_steps(steps, [("open", "closed")]).collect()} == {("open", "closed"): True, ("closed", "open"): False, ("open", "open"): True}


def test_bounded_traces(spark):
    rnd = random.Random(7)
    nodes = [f"n{i:02}" for i in range(14)]
    pairs = [tuple(rnd.sample(nodes, 2)) for _ in range(40)] + [("hub", f"leaf{i:04}") for i in range(500)] + [("n00", "hub"), ("n00", "n00")]
    v, e = make(spark, pairs)
    for hops, most in ((3, 5), (4, 10_000), (2, 1)):
        want = {}
        for r in graph.simple_paths(e.where("src <> dst"), v, hops).collect():
            want.setdefault(r["source"], []).append((list(r["path"]), r["end_state"]))
        got = {}
        for r in graph.bounded_paths(e, v, hops, most).collect():
            got.setdefault(r["source"], []).append((list(r["path"]), r["end_state"]))
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x)[:most] for k, x in want.items()}


def test_a_star_is_traced_without_its_leaves(spark, monkeypatch):
    v, e = make(spark, [("hub", f"x{i:05}") for i in range(20_000)])
    rows, keep = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append((out := keep(df)).count()) or out)
    asked = spark.createDataFrame([("hub",), ("x-00003",), ("none",)], "request string")
    got = network.trace_requests(asked, v, e, 3, 50).collect()
    assert max(rows) <= 110 and sum(r["request"] == "hub" for r in got) == 50
    assert {(r["request"], r["status"]) for r in got} == {("hub", "found_bounded"), ("x-00003", "found"), ("none", "not_found")}
    got = network.trace_requests(asked, v, e.where("src = 'x'"), 3, 50, transfers=True).collect()
    assert {(r["request"], r["status"]) for r in got} == {("hub", "insufficient_data"), ("x-00003", "insufficient_data"), ("none", "not_found")}


def test_runs_are_versioned(spark, tmp_path):
    v, e = make(spark, [("p", "f1"), ("q", "f1"), ("r", "f1"), ("p", "f2"), ("q", "f2"), *[("hub", f"leaf{i:02}") for i in range(10)]])
    v = v.withColumn("entity_type", F.when(F.col("entity_id").startswith("f"), "organization").otherwise("person"))
    seen = e.select("case_id", "src", "dst", F.concat("src", F.lit("-"), "dst").alias("record_id"))
    at = str(tmp_path)
    told = {r["name"]: r["rows"] for r in network.full_run(v, e, seen, at, "1").collect()}
    assert told["metrics"] == 5 * v.count() and set(told) == set(network.TABLES)
    v.write.parquet(f"{at}/runs/2/metrics")  # broken off
    t = network.last_run(spark, at)
    found = {(r["kind"], r["entity_id"]): r["finding_id"] for r in t["findings"].collect()}
    assert ("concentration", "hub") in found and ("missing_link", "p>q") in found
    rests = {r["record_id"] for r in t["evidence"].where(F.col("finding_id") == found["missing_link", "p>q"]).collect()}
    assert rests == {"p-f1", "q-f1", "p-f2", "q-f2"}
    v.write.mode("overwrite").parquet(f"{at}/runs/1/profiles")
    with pytest.raises(ValueError, match="profiles"):
        network.last_run(spark, at)


def test_centrality_records_and_ranks(spark):
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("b", "d")]
    v, e = make(spark, pairs, ["z"])
    rows = measures.centrality_records(v, e).collect()
    assert {r["metric"] for r in rows} == set(measures.METRICS) and len(rows) == 6 * 5 and all(r["exact"] for r in rows)
    for m in measures.METRICS:
        own = sorted((r for r in rows if r["metric"] == m), key=lambda r: r["rank"])
        assert [(-r["raw"], r["entity_id"]) for r in own] == sorted((-r["raw"], r["entity_id"]) for r in own) and [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert own[0]["normalized"] == (1.0 if own[0]["raw"] else 0.0)
    want = brute_structure(["a", "b", "c", "d", "z"], pairs)
    for r in rows:
        if r["metric"] in ("betweenness", "closeness"):
            assert r["raw"] == pytest.approx(want[r["entity_id"]][2 if r["metric"] == "betweenness" else 3], abs=1e-8)
    assert {r["exact"] for r in measures.centrality_records(v, e, exact=2, pivots=2).collect() if r["metric"] == "closeness"} == {False}
    assert [(r["entity_id"], r["value"]) for r in measures.ranked_by(v, e, "relationship_count", 2).orderBy("rank").collect()] == [("b", 4.0), ("a", 2.0)]
    assert [(r["entity_id"], r["entities"]) for r in measures.ranked_by(v, e, "degree", 1).collect()] == [("b", 5)] == [(r["entity_id"], r["entities"]) for r in measures.ranked_by(v, e, "distinct_neighbors", 0).collect()]
    assert measures.ranked_by(v, e, "pagerank", 999).count() == 5
    with pytest.raises(measures.UnsupportedMetric):
        measures.ranked_by(v, e, "wealth")
