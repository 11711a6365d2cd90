"""Fingerprints, near duplicates and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, fingerprints, simhash
from tracewell.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [w[i : i + 3] for i in range(len(w) - 2)] or [w]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, docs, rows, no_docs):
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    root = brute_components({f for _, f in fps}, [(a, b) for _, a in fps for _, b in fps if bin(a ^ b).count("1") <= 3])
    least = defaultdict(list)
    for d, f in fps:
        if d is not None:
            least[root[f]].append(d)
    assert got == Counter((d, f, min(least[root[f]], default=None)) for d, f in fps)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(root.values())) and simhash.one_of_each(docs).columns == docs.columns
    assert {brute_fingerprint(r["text"]) in root for r in kept} == {True}
    assert len({root[brute_fingerprint(r["text"])] for r in kept}) == len(kept)


def test_links_by_levels(spark):
    rnd = random.Random(4)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    dense = rnd.getrandbits(64)
    fps |= {dense ^ rnd.getrandbits(9) ^ (rnd.getrandbits(3) << 40) for _ in range(300)}  # a region to split
    for x in list(fps)[:200]:
        for _ in range(3):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for node in (16, 2048):
        links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(df, node=node).collect()]
        assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
        want = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3])
        assert brute_components(fps, links) == want


def test_trie_is_a_forest():
    fps = np.array(sorted({(7 << 50) ^ k for k in range(600)}), np.uint64)
    got = simhash.trie_links(fps, np.array([[0, len(fps), 0, len(fps)]]), 0)
    assert len(got) == len(fps) - 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_contamination(spark, docs, rows, no_docs):
    some = [t for _, t in rows if t and len(brute_words(t)) > 30]
    w = brute_words(some[3])
    items = [(1, " ".join(w[4:30])), (22, "Ba, RA"), (3, None), (4, "..."), (None, " ".join(w[20:32])), (1, " ".join(brute_words(some[5])[:12])), (7, "zz " * 12), (8, "ba ra te li mo st ba ra te zz"), (22, "Ba, RA")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect())
    want, clean = Counter(), []
    for d, t in rows:
        w, hit, names = brute_words(t), set(), set()
        for item, text in items:
            v = brute_words(text)
            for k in range(max(1, len(v) - 9)) if v else ():
                win = v[k : k + 10]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        names.add("" if item is None else str(item))
        want[d, len(w), len(hit), tuple(sorted(names)), bool(hit)] += 1
        clean += [(d, t)] * (not hit)
    assert got == want
    assert sum(1 for k in want if k[4]) >= 3
    assert Counter((r["doc_id"], r["text"]) for r in decontaminate.without_contaminated(docs, bench).collect()) == Counter(clean)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a d e f g h b"), (2, "b"), (3, None)], "doc_id long, text string")
    got = decontaminate.proximity_matches(decontaminate.postings(docs), "a", "b", 2).collect()
    assert {(r["d"], r["pos"], r["other"]) for r in got} == {(1, 0, 1), (1, 3, 1)}


def brute_vector(text, h):
    """Lanes and cells of a text by hand; h: a paragraph and a seed to its hash."""
    lanes, cells = [0] * fingerprints.LANES, [0] * (fingerprints.STRATA * fingerprints.CELLS)
    for p in re.split(r"(?<=[.!?])[ \n]+|\n+", text):
        if not p:
            continue
        for k in range(fingerprints.LANES // 2):
            x = h[p, k]
            lanes[2 * k] = (lanes[2 * k] + (x & 0xFFFFFFFF)) % 2**32
            lanes[2 * k + 1] = (lanes[2 * k + 1] + (x >> 32)) % 2**32
        x = h[p, -1]
        stratum = next((s for s in range(fingerprints.STRATA - 1) if x >> s & 1), fingerprints.STRATA - 1)
        cells[stratum * fingerprints.CELLS + (x >> 24) % fingerprints.CELLS] += (x >> 40) + 2**40
    return lanes, cells


def brute_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    best = [(x, y) for x, y in used if max(x, y) < 2**41] or used
    return sum(x == y for x, y in best) / len(best) if best else 1.0


def test_fingerprints(spark, docs, rows, no_docs):
    """Every column, against the sums made by hand from the hashes of all paragraphs."""
    down = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    edited = []
    for i, (d, t) in enumerate(down):
        t, after = t or "", down[(i + 1) % len(down)][1] or ""
        edited.append(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
    units = sorted({p for t in [*(t or "" for _, t in rows), *edited] for p in re.split(r"(?<=[.!?])[ \n]+|\n+", t) if p})
    seeds = [-1, *range(fingerprints.LANES // 2)]
    hashed = spark.createDataFrame([(p,) for p in units], "p string").select("p", *[F.xxhash64("p", F.lit(s)).alias(f"h{s}") for s in seeds]).collect()
    h = {(r["p"], s): r[f"h{s}"] & (2**64 - 1) for r in hashed for s in seeds}

    def text_of(v):
        return "".join(f"{x:08x}" for x in v[0]) + "".join(f".{i:x}-{x:x}" for i, x in enumerate(v[1]) if x)

    own, new = [brute_vector(t or "", h) for _, t in down], [brute_vector(t, h) for t in edited]
    want = Counter()
    for i, (d, t) in enumerate(down):
        near = brute_likeness(own[i][1], new[i][1]), brute_likeness(own[i][1], own[(i + 1) % len(down)][1])
        want[d, len(t or ""), hashlib.sha256(edited[i].encode()).hexdigest(), text_of(own[i]), text_of(new[i]), *(round(x, 9) for x in near)] += 1
    got = fingerprints.fingerprint_edits(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.select(*names).collect()) == want
    # the likeness follows from the fingerprints that are returned
    again = got.select("near_edited", fingerprints.likeness(fingerprints.cells_of(F.col("fingerprint")), fingerprints.cells_of(F.col("edited_fingerprint"))).alias("x"))
    assert all(r["near_edited"] == r["x"] for r in again.collect())
    assert fingerprints.fingerprint_edits(no_docs).count() == 0


def test_fingerprint_is_homomorphic(spark):
    one, two = "A line here.\nAnother one. ", "More text!\nA line here."
    texts = [(0, one), (1, two), (2, one + "\n" + two), (3, two + "\n" + one), (4, one + "\n" + two + "\nextra"), (5, "extra")]
    v = {r["k"]: r for r in fingerprints.vectors(spark.createDataFrame(texts, "k int, s string"), ["k"], "s").collect()}
    assert v[2]["lanes"] == v[3]["lanes"] and v[2]["cells"] == v[3]["cells"]
    df = spark.createDataFrame([(v[0]["lanes"], v[1]["lanes"], v[4]["lanes"], v[5]["lanes"])], "a array<long>, b array<long>, c array<long>, d array<long>")
    r = df.select(fingerprints.combined(F.col("a"), F.col("b")).alias("sum"), fingerprints.combined(F.col("c"), F.col("d"), -1).alias("less")).first()
    assert r["sum"] == v[2]["lanes"] and r["less"] == v[2]["lanes"] != v[4]["lanes"]


def test_likeness_at_any_length(spark):
    for n in (10, 1000, 50_000):
        a = [f"line {i} of the text" for i in range(n)]
        half = a[: n // 2] + [f"other {i} of the text" for i in range(n - n // 2)]
        few = a[: n - n // 10] + [f"other {i} of the text" for i in range(n // 10)]
        rows = [(0, "\n".join(a)), (1, "\n".join(half)), (2, "\n".join(few)), (3, "\n".join(a))]
        v = {r["k"]: r["cells"] for r in fingerprints.vectors(spark.createDataFrame(rows, "k int, s string"), ["k"], "s").collect()}
        df = spark.createDataFrame([(v[0], v[1], v[2], v[3])], "a array<long>, b array<long>, c array<long>, d array<long>")
        half, few, all_ = df.select(*[fingerprints.likeness(F.col("a"), F.col(c)) for c in "bcd"]).first()
        # of shared and changed paragraphs, the share that is shared: 1/3 and 9/11
        assert all_ == 1 and abs(half - 1 / 3) < 0.3 and abs(few - 9 / 11) < 0.3 and half < few, (n, half, few)
