"""What the findings of round 4 were about, on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import contradictions, crosscase, hypotheses, structure, triage
from tracewell.plans import q_graph, registry


def test_records_take_their_claims_to_their_anchors(spark):
    """pairs of records and their claims were shuffled field by field; names were classified anew in each row."""
    pairs = [("Txn Ref", "ref"), ("Order ID", "other"), ("value_date", "day"), ("Amount", "amount"), ("amount ", "more"), ("Status", "status"), ("note", "note")]
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    rows = [(f"r{i:02}", pick("A-1", "a/1", "B 2", "N/A", None, " "), pick("a1", "b2", "C3", "", "2024-01-02"), pick("2024-01-02", "2/1/2024", "2024-01-02T03:04", "2024-01-03 03:04", "soon"), pick("1,200", "1200.0", "$7", "x", " "), pick("5", "-"), pick("ok", "OK ", "bad", "12"), pick("$9", "2024-01-02", "e")) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, ref string, other string, day string, amount string, more string, status string, note string")
    each = F.posexplode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in pairs])).alias("pos", "x")
    claimed = contradictions.claims(df.select("record_id", each).select("record_id", "pos", "x.field", "x.value"))
    records, ids = contradictions.record_claims(df, pairs)
    names = ["record_id", "field", "kind", "original", "compared", "transaction"]
    got = records.select("record_id", F.explode("cs").alias("c")).select("record_id", *[f"c.{n}" for n in names[1:]])
    assert ids == 2 and sorted(map(tuple, got.collect())) == sorted(map(tuple, claimed.select(*names).collect()))
    by = {}
    for r in claimed.collect():
        by.setdefault(r["record_id"], {})[r["field"]] = r
    day = lambda v: "T" not in v and ":" not in v
    anchors, scope, want = {}, {}, set()
    for i, cs in sorted(by.items()):
        for c in cs.values():
            if c["kind"] == "identifier" and c["compared"]:
                if i not in anchors.setdefault(c["compared"], []):
                    anchors[c["compared"]].append(i)
                scope[c["compared"]] = scope.get(c["compared"], False) or c["transaction"]
    for a in sorted(by):
        for b in sorted(by):
            met = [x for x, held in anchors.items() if a < b and a in held[:12] and b in held[:12]]
            if met:
                x, n = min(met), 0
                for f in sorted(set(by[a]) & set(by[b])):
                    p, q = by[a][f], by[b][f]
                    cut = 10 if p["kind"] == "date" and (day(p["original"]) or day(q["original"])) else None
                    fit = scope[x] or (p["kind"] not in ("amount", "currency", "date") and not p["transaction"])
                    if p["kind"] == q["kind"] and fit and p["compared"][:cut] != q["compared"][:cut] and n < 2:
                        want.add((x, "transaction" if scope[x] else "entity", a, b, p["kind"], f, p["original"], q["original"]))
                        n += 1
    assert len(want) > 50 and len(anchors) > 2
    for found in (contradictions.record_conflicts(records, 12, 2, ids=ids), contradictions.conflicts(claimed, 12, 2)):
        assert {tuple(r) for r in found.collect()} == want
    plan = contradictions.record_conflicts(contradictions.record_claims(df, pairs[:1] + pairs[2:])[0], ids=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_searches_are_whole_at_any_size(spark):
    """cases of over 2000 vertices were searched from about 256 of them. Two stars of 1,100 leaves side by side have known sums."""
    m = 1100
    leaf = spark.range(2 * m).select(F.lit(1).alias("case_id"), F.col("id").cast("string").alias("src"), F.when(F.col("id") < m, "p").otherwise("q").alias("dst"))
    rels = leaf.union(spark.createDataFrame([(1, "p", "q")], "case_id int, src string, dst string"))
    vertices = leaf.select("case_id", F.col("src").alias("entity_id")).union(leaf.select("case_id", "dst").distinct())
    rows = structure.centrality(vertices, rels).collect()
    assert len(rows) == 2 * m + 2 and all(r["exact"] for r in rows)
    for r in rows:
        hub = r["entity_id"] in "pq" and not r["entity_id"].isdigit()
        assert r["betweenness"] == pytest.approx(m * (m - 1) / 2 + m * (m + 1) if hub else 0)
        assert r["closeness"] == pytest.approx(((m + 1) + m / 2 if hub else 1 + (m - 1) / 2 + 1 / 2 + m / 3) / (2 * m + 1))


def test_searches_by_joins_give_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    pairs = [(c, f"v{rnd.randrange(40)}", f"v{rnd.randrange(40)}") for c in ("x", "y") for _ in range(30 if c == "x" else 60)]
    rels = spark.createDataFrame(pairs, "case_id string, src string, dst string")
    vertices = spark.createDataFrame([(c, f"v{i}") for c in ("x", "y") for i in range(40)] + [("z", "alone")], "case_id string, entity_id string")
    rows = lambda held: {(r["case_id"], r["entity_id"]): (pytest.approx(r["betweenness"]), pytest.approx(r["closeness"])) for r in structure.centrality(vertices, rels, held=held).collect()}
    want = {(r["case_id"], r["entity_id"]): (r["betweenness"], r["closeness"]) for r in structure.centrality(vertices, rels).collect()}
    monkeypatch.setattr(structure, "ROWS", 81)  # one block of sources at once
    assert rows(80) == want and len(want) == 81 and sum(b for b, _ in want.values()) > 0


def test_packages_are_dealt_once(spark):
    """entries and files were dealt for each code."""
    h = lambda x: x * 64
    e = [("a", "x", h("1"), 1), ("a", "x", h("2"), 1), ("a", None, h("3"), 1), ("b", "x", h("1"), 1), ("b", "y", h("1"), 2), ("c", "x", h("A"), 3), ("d", "x", None, 1), ("d", "y", None, -1), (None, "x", "bad", 1), ("f", "x", h("4"), 1)]
    f = [("a", "x", h("5"), 1), ("a", None, h("3"), 1), ("b", "x", h("1"), 7), ("b", "z", h("1"), 2), ("c", "x", h("a"), 3), ("d", "x", None, 1), ("d", "y", h("1"), 1), ("e", "x", h("1"), 1), (None, "x", h("2"), 9), ("f", "x", h("4"), 1)]
    of = lambda rows: spark.createDataFrame(rows, "package_id string, filename string, sha256 string, size long")
    out = triage.package(of(e), of(f), spark.createDataFrame([("f",), ("f",), ("e",)], "package_id string"))
    got = {r["package_id"]: (r["entries"], ",".join(r["codes"]), r["accepted"]) for r in out.collect()}
    assert got == {
        "a": (3, "duplicate_name,file_missing,file_unlisted,hash_mismatch,manifest_incomplete", False), "b": (2, "duplicate_hash,file_missing,file_unlisted,size_mismatch", False), "c": (1, "", True),
        "d": (2, "duplicate_hash,manifest_incomplete,size_mismatch", False), None: (1, "", True), "f": (1, "replayed", False),
    }
    plan = registry.queries()["S22_package_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 3


def test_priorities_find_communities_once(spark, monkeypatch):
    """communities were found twice, and entities and relationships made anew for each step."""
    calls, made = [], []
    monkeypatch.setattr(structure, "communities", lambda e, r: calls.append(r) or e.select("case_id", "entity_id", F.col("entity_id").alias("community")))
    monkeypatch.setattr(hypotheses, "missing_links", lambda r, actors, member: made.append(member) or spark.createDataFrame([], "case_id int, a string, b string"))
    monkeypatch.setattr(q_graph.blocks, "cut_structure", lambda e, r: e.select("case_id", "entity_id", F.lit(0.0).alias("bridge_score")))
    monkeypatch.setattr(q_graph.graph, "pagerank", lambda e, r: e.select("case_id", "entity_id", F.lit(0.5).alias("pagerank")))
    rows = registry.queries()["G23_priorities"](spark, "/root/testdata/sf0.001")
    assert len(calls) == len(made) == 1 and "lineitem" not in "".join(rows.inputFiles())


@pytest.mark.parametrize("loose", [True, False])
def test_candidates_count_without_a_row_for_each_pair(spark, monkeypatch, loose):
    """candidates wrote and shuffled a row for each pair of values and its record and file; blocks were all dealt at once."""
    for name, size in (("BLOCK", 400), ("SENT", 500), ("HELD", 50)):
        monkeypatch.setattr(crosscase, name, size)
    rnd = random.Random(2)
    maybe = lambda x: None if rnd.random() < 0.2 else x
    rows = []
    for i in range(130):
        r, e = rnd.randrange(60), maybe(f"e{rnd.randrange(9)}")
        f, r = (maybe(f"f{rnd.randrange(25)}"), maybe(f"r{r}")) if loose else (f"f{r // 3}", f"r{r}")
        rows.append((rnd.randrange(3), rnd.choice(["account", "document", "name"]), f"v{rnd.randrange(14)}", rnd.choice("xX") if i % 5 == 0 else "x", e, r, f, rnd.random() < 0.03))
    rows += [(c, "phone", "alone", "x", None, None, None, False) for c in (0, 1)]
    ind = spark.createDataFrame(rows, "case_id long, kind string, value string, original string, entity_id string, record_id string, file_id string, reviewed boolean")
    want = set()
    for k, v in {r[1:3] for r in rows}:
        held = [r for r in rows if r[1:3] == (k, v)]
        cases = {r[0] for r in held}
        if len(cases) < 2:
            continue
        met = {c: {r for r in rows for h in held if r[0] == h[0] == c and (r is h or any(x is not None and x == y for x, y in zip(r[4:7], h[4:7], strict=True)))} for c in cases}
        support = sum(min(3, len({r[i] for r in m if r[i] is not None})) for m in met.values() for i in (5, 6))
        extra, conflict = [], []
        for other in ("account", "document", "phone"):
            sides = [{r[2] for r in m if r[1] == other} for m in met.values()]
            if other != k and all(sides):
                (extra if set.intersection(*sides) else conflict).append(other)
        same = len({frozenset(r[3] for r in held if r[0] == c) for c in cases}) == 1
        label = "reviewed_alias" if any(r[7] for r in held) else ("exact_identifier" if same else "normalized_identifier") if k != "name" else "normalized_identifier" if extra else "similarity_name_only"
        score = min(100, crosscase.BASE[label] + min(20, 5 * len(extra)) + min(15, 3 * max(0, support - len(cases))))
        want.add((k, v, len(cases), label, tuple(extra), tuple(conflict), score, label != "similarity_name_only"))
    turns = []
    of = crosscase.cut
    monkeypatch.setattr(crosscase, "cut", lambda df: turns.append(df.columns) or of(df))
    got = {(*r[:4], tuple(r[4]), tuple(r[5]), *r[6:]) for r in map(tuple, crosscase.candidates(ind, most=3).collect())}
    assert got == want and len(want) > 20 and sum(c == ["code", "c", "k", "n"] for c in turns) > 1
