"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tracewell.llm import similar


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    rnd = random.Random(9)
    word = lambda: f"{rnd.choice('bdfgklmn')}{rnd.choice('aeiou')}{rnd.randrange(400)}"
    out = []
    for i in range(30):
        base = [word() for _ in range(rnd.choice((60, 200, 900)))]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):
            w = list(base)
            for k in rnd.sample(range(len(w)), max(1, int(len(w) * share))):
                w[k] = word()
            out.append(" ".join(w))
        for cut in (0.83, 0.9, 0.79):
            out.append(" ".join(base[: int(len(base) * cut)]))
    chain = [word() for _ in range(300)]  # each like the one before it, the last unlike the first
    out += [" ".join(chain[20 * i : 20 * i + 200]) for i in range(6)]
    dense = [word() for _ in range(150)]
    out += [" ".join(dense[:k] + [word()] + dense[k + 1 :]) for k in range(0, 150, 3)]
    rnd.shuffle(out)
    return out


def kept(rows):
    """The first of similar ones, in order of doc_id: comparing with all kept before."""
    out = []
    for d, t in sorted(rows):
        s = shingles(t)
        if all(jaccard(s, x) < 0.8 for _, x in out):
            out.append((d, s))
    return [d for d, _ in out]


def test_planted_copies(spark):
    rows = [(5 * i + 1, t) for i, t in enumerate(planted())]
    want = kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").orderBy("doc_id").collect()] == want
    few = [r for r in rows if r[0] % 4 == 1]
    want, docs = kept(few), spark.createDataFrame(few, docs.schema)
    assert [r["doc_id"] for r in similar.one_of_similar(docs, heads=4).orderBy("doc_id").collect()] == want  # many rounds


def test_defined_results(spark, docs, rows, no_docs):
    got = similar.one_of_similar(docs)
    assert got.columns == docs.columns and similar.one_of_similar(no_docs).count() == 0
    sets = [shingles(r["text"]) for r in got.collect()]
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
    assert all(any(jaccard(shingles(t), s) >= 0.8 for s in sets) for _, t in rows)
    assert not Counter((r["doc_id"], r["text"]) for r in got.collect()) - Counter(rows)


def test_prefixes_of_similar_sets_meet():
    """Sets at 0.8 or more share a shingle of their prefixes, early enough for what is left of both; common ones come last."""
    rnd = random.Random(5)
    common = np.array(sorted((h, rnd.randint(2, 99)) for h in rnd.sample(range(400), 120)), [("h", np.int64), ("n", np.int64)])
    met = tried = 0
    for _ in range(4000):
        a = set(rnd.sample(range(400), rnd.randint(1, 60)))
        b = set(a) if rnd.random() < 0.9 else set(rnd.sample(range(400), 30))
        for x in rnd.sample(sorted(b), min(len(b) - 1, rnd.randint(0, 6))):
            b.remove(x)
        b |= set(rnd.sample(range(400), rnd.randint(0, 4)))
        x, y = (similar.prefix(np.array(sorted(s), np.int64), common).tolist() for s in (a, b))
        fits = any(h in y and min(len(a) - i, len(b) - y.index(h)) * 18 >= (len(a) + len(b)) * 8 for i, h in enumerate(x))
        if 10 * len(a & b) >= 8 * len(a | b):
            tried += 1
            assert fits
        met += fits
    assert tried > 1000 and met < 4000
    often = set(common["h"].tolist())
    some = similar.prefix(np.arange(400), common).tolist()
    assert len(some) == 81 and not often & set(some)


def test_a_family_that_is_not_similar_costs_few_pairs(spark, monkeypatch):
    """Documents with a long passage in common, below 0.8, are not compared pair by pair."""
    rnd = random.Random(8)
    word = lambda: f"{rnd.choice('bdfgklmn')}{rnd.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(24))])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    made, keep = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, sets: made.append(pairs.count()) or keep(pairs, sets))
    kept = similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept == 400 and sum(made) < 25 * 400  # all pairs: 79,800
