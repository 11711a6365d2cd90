"""Filter audit, certified repacking and hard negatives against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import filter_audit, negatives, repacking
from tracewell.llm.common import batches_bounded, staged
from tracewell.llm.tokens import Encoder, vocabulary


# filter audit


def failed(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return {f for f, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text))) if bad}


def brute_audit(rows, labels):
    """rows: doc_id, text, lang; labels: doc_id, quality, toxic."""
    texts = [t or "" for _, t, _ in rows]
    marks = defaultdict(lambda: [0, 0])
    for d, q, x in labels:
        marks[d] = [max(marks[d][0], int(q == 1)), max(marks[d][1], int(x == 1))]
    fails = []
    for (d, _, lang), t in zip(rows, texts):
        copy = d is not None and any(e is not None and e < d and t == u for (e, *_), u in zip(rows, texts))
        fails.append((lang or "", failed(t) | ({"E"} if copy else set()), *(marks[d] if d is not None else (0, 0))))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [x for x in own if f in x[1] and not x[1] & before]
                out[part, order, k + 1] = [sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    shapley = Counter()
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] += v[1]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rnd.choice((3, 150, 260)))) for _ in range(25)]
    texts += [t + " " + s for t in texts[:8] for s in ("X" * 90, "50%", "|", "no no " * 150)]
    texts += [None, "", " ", "\t\n", "A", "x" * 5000, texts[0][:-1], texts[0] + " ", "prefix " * 400 + "a", "prefix " * 400 + "b", "B\x00C"]
    rows = [(i * 3 - 20, t, rnd.choice(("en", "de", None))) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i % 7], rnd.choice(("en", "fr"))) for i in range(60)]  # copies
    rows += [rows[0], (rows[1][0], texts[5], "en"), (None, texts[3], "en"), (None, texts[3], None), (-900, texts[3], "xx")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_filter_audit(spark, monkeypatch, small):
    if small:  # many tries, ranges and batches, so that most copies meet across them
        for name, value in {"TRIE": 3000, "RANGE": 500, "HEAD": 30, "OUT_ROWS": 7}.items():
            monkeypatch.setattr(filter_audit, name, value)
    rows = audit_rows()
    labels = [(d, i % 2, i % 3 == 0) for i, (d, *_) in enumerate(rows)] + [(None, 1, 1), (5, None, 1), (5, 1, 0)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, mask string, n int").repartition(5)
    marks = spark.createDataFrame([(d, q, int(x) if x is not None else None, "m") for d, q, x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, marks).collect()}
    want = brute_audit(rows, labels)
    assert got.keys() == want.keys() and all(len({*[p for p, *_ in want]}) * 600 == len(x) for x in (got, want))
    assert got == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_tries_hold_what_was_put_in():
    rnd = random.Random(4)
    keys = {bytes(rnd.choices(b"ab", k=rnd.randint(0, 12))) for _ in range(600)} | {b"x" * 9000 + bytes([k]) for k in range(9)}
    t = filter_audit.Trie()
    for k in sorted(keys, key=lambda _: rnd.random()) * 2:
        t.at(k)[2] = k
    assert [k for k, _ in t.terminals()] == sorted(keys) and all(k == v for k, v in t.terminals())
    assert t.size < sum(map(len, keys)) / 4  # what texts share is held once


def test_ranges_follow_long_shared_prefixes(spark):
    texts = [f"{'the same beginning ' * 20}{i:04d}" for i in range(2000)] + [f"{i:04d}" + "x" * 380 for i in range(600)]
    bounds = filter_audit.range_bounds(spark.createDataFrame([(t,) for t in texts], "text string"), 16, len(texts))
    held = Counter(sum(b <= t.encode() for b in bounds) for t in texts)
    assert bounds == sorted(set(bounds)) and len(bounds) >= 12 and max(held.values()) < len(texts) / 4
    assert any(len(b) > 350 for b in bounds) and any(len(b) < 6 for b in bounds)


# repacking


def fewest(sizes, window):
    """Bins of the best packing, by search."""
    best = [len(sizes)]

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(free)
            return
        for k in range(len(free)):
            if free[k] >= sizes[i] and free[k] not in free[:k]:
                go(i + 1, [*free[:k], free[k] - sizes[i], *free[k + 1 :]])
        go(i + 1, [*free, window - sizes[i]])

    go(0, [])
    return best[0]


def test_bounds_and_best_fit():
    rnd = random.Random(6)
    tight = 0
    for window in (10, 13, 24):
        bound = repacking.Bounds.of(window)
        for _ in range(150):
            sizes = sorted((rnd.randint(1, window) for _ in range(rnd.randint(1, 9))), reverse=True)
            least = bound.bins(np.bincount(sizes, minlength=window + 1))
            need = fewest(sizes, window)
            assert -(-sum(sizes) // window) <= least <= need, (sizes, window)
            tight += least == need
            bins, offsets, free = repacking.best_fit_decreasing(np.array(sizes), window)
            inside = defaultdict(list)
            for s, b, at in zip(sizes, bins, offsets):
                inside[b].append((at, s))
            for b, rows in inside.items():
                rows.sort()
                assert [at for at, _ in rows] == np.cumsum([0, *[s for _, s in rows]])[:-1].tolist() and sum(s for _, s in rows) + free[b] == window
            assert len(free) >= need
    assert tight > 400  # of 450
    # one item of each bin of a full packing never counts over 1
    values, den = repacking.dual_feasible(24)
    for _ in range(300):
        rest, bin_ = 24, []
        while rest:
            bin_.append(rnd.randint(1, rest))
            rest -= bin_[-1]
        assert (values[:, bin_].sum(axis=1) <= den).all()


def holds(rows, window):
    """Checks places, returns the number of sequences. rows: sequence_id, offset, length."""
    at = defaultdict(list)
    for s, o, n in rows:
        at[s].append((o, n))
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) <= window
    return len(at)


def test_repacking(spark, docs, rows, no_docs):
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    got = repacking.pack(docs, vocabulary("byte_bpe_50k.json"), 2, window=64, per_part=40, group=3).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    want = Counter()
    for d, t in rows:
        ids = [*e.encode(t).tolist(), 2]
        head = (len(ids) - 1) % 64 + 1
        for k in range(-(-len(ids) // 64)):
            a, b = (0, head) if k == 0 else (head + 64 * (k - 1), head + 64 * k)
            data = np.array(ids[a:b], "<u4").tobytes()
            want[d, k, a, b - a, zlib.crc32(data), len(ids), data] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) for r in got) == want
    used = holds([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    bound = repacking.Bounds.of(64).bins(np.bincount([r["length"] for r in got], minlength=65))
    assert bound <= used <= bound * 1.01 + 1
    assert repacking.pack(no_docs, vocabulary("byte_bpe_50k.json"), 2).count() == 0


@pytest.mark.parametrize("low,high", [(1, 400), (300, 700), (520, 1024), (1024, 1025)])
def test_exchange_of_parts(spark, low, high):
    size = F.lit(low) + F.pmod(F.xxhash64("id"), F.lit(high - low))
    zero = F.lit(0).cast("long")
    items = staged(spark.range(6000).select(F.col("id").alias("rid"), F.col("id").alias("doc_id"), F.lit(0).alias("piece"), zero.alias("start"), size.alias("length"), zero.alias("ids_crc32"), size.alias("doc_tokens")), "t")
    alone = repacking.place(items, per_part=100, rounds=0).collect()
    together = repacking.place(items, per_part=100, group=4)
    (said,) = repacking.certificate(together).collect()
    rows = together.collect()
    assert Counter(r["rid"] for r in rows) == Counter(range(6000))
    used = holds([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 1024)
    before = holds([(r["sequence_id"], r["offset"], r["length"]) for r in alone], 1024)
    assert said["sequences"] == used and said["bound"] <= used <= before
    if low == 1:
        assert used < before and used <= said["bound"] * 1.005
    if low >= 520:
        assert used == said["bound"] and all(r["certified"] for r in rows)


# hard negatives


def brute_negatives(rows, every=100):
    x = []
    for d, v, label in rows:
        if label is None or v is None or any(c is None or c != c or abs(c) == float("inf") for c in v):
            continue
        x.append((d, [int(np.floor(256 * float(np.float32(c)))) for c in v], (label + 1) % 10 if d is not None and d % 7 == 0 else label))
    last = lambda d: (d is None, d or 0)
    out = Counter()
    for a, v, label in {(d, tuple(v), n) for d, v, n in x if d is not None and d % every == 0}:
        scored = [(sum(p * q for p, q in zip(v, w)), d, n) for d, w, n in x if d != a]
        pos = sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:5]
        for ps, p, _ in pos:
            neg = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=lambda s: (-s[0], last(s[1])))[:10]
            for k, (ns, n, _) in enumerate(neg, 1):
                out[a, p, k, n, ps, ns] += 1
    return out


def vectors(n, dims, seed, spread=0.3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i - 50, [x * rnd.choice((1, 0.5)) + rnd.gauss(0, spread) for x in c], rnd.randint(0, 9) if i % 3 else 1))
    return out


@pytest.mark.parametrize("dims,block", [(3, 90), (16, 10_000), (16, 60)])
def test_hard_negatives(spark, monkeypatch, dims, block):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = vectors(400, dims, dims)
    one = rows[80][1]
    rows += [(10_000 + i, one, 2 + i % 2) for i in range(60)]  # copies of a vector, so ties
    rows += [(100, None, 1), (200, rows[0][1], None), (300, [1.0, None] * 2, 1), (14, [float("nan")] * dims, 1), (21, [float("inf")] * dims, 1), (500, [0.0] * dims, 1), (600, [], 3), (700, [0.5], 3), (800, [-3.0] * dims, 4), (None, one, 2), (None, rows[9][1], 5), (-100, rows[70][1], 1), rows[80], rows[150], (100, rows[3][1], 8)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, anchor string, score int").repartition(3)
    got = Counter(tuple(r) for r in negatives.mine(df, every=50, block=block).collect())
    want = brute_negatives(rows, 50)
    assert got == want and len(want) > 300
    assert negatives.mine(df.limit(0)).count() == 0


def test_walks_stop_early_and_miss_nothing():
    rnd = np.random.default_rng(5)
    x = np.floor(256 * rnd.normal(0, 0.3, (20_000, 3)))
    lists, ids = negatives.Lists(x, np.arange(20_000)), np.arange(20_000)
    for a in np.floor(256 * rnd.normal(0, 0.3, (20, 3))):
        rows, scores = lists.walk(a, np.ones(20_000, bool), lambda r, s, t: len(s) >= 10 and t < np.sort(s)[-10])
        whole = (x @ a).astype(np.int64)
        best = negatives.first(ids, whole, 10)
        assert rows[negatives.first(ids[rows], scores, 10)].tolist() == best.tolist()
        assert len(rows) < 10_000
    huge = negatives.Lists(np.array([[2.0**60, 1.0], [2.0**60, 2.0], [2.0**70, 0.0]]), np.arange(3))
    assert huge.scores(np.arange(3), np.array([2.0, 1.0])).tolist() == [2**61 + 1, 2**61 + 2, 2**63 - 1]


def test_byte_strings_of_the_session(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        assert batches_bounded(docs) is docs and spark.conf.get(key) == str(8 << 20)
        spark.conf.set(key, "1m")
        batches_bounded(docs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
