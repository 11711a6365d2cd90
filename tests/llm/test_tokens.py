"""Ids, counts, packing and sharding against the libraries and brute force."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import counts, idstore, packing, sharding, tokens
from tracewell.llm.common import bucket_of, running_start, scratch
from tracewell.llm.tokens import Encoder, vocabulary

PARTS = ["a", "É", "foo", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", " \n", "\n ", ".", ",!", "123", "½", "²", "x1y", "<|endoftext|>", "<|startoftext|>", "日本", "é", " ", " ", "\x1c", "İ", "Σας", "▁", "👍🏽", "_", "ﬁ", "\x00", "'LL", "Σ", "ΟΔΟΣ", "Ω", "\xa0", "\x85", "\u0301", "Ǆ", "Ⱥ", "\xad", "'s'", "<s>", "<unk>", "\r\n"]


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, texts):
    e = Encoder(vocabulary(name))
    many = [*fuzz(20_000), *[t for t in texts if t], None, "ΟΔΟΣ "]
    ids, starts = e.encode_all(pa.array(many), 7)
    for i, t in enumerate(many):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*e.lib.encode(t or "", add_special_tokens=False).ids, 7], repr(t[:80])
    assert len(e.encode(None)) == 0 and e.encode("ΟΔΟΣ ").tolist() == e.lib.encode("ΟΔΟΣ ", add_special_tokens=False).ids
    e.known, words, tokens.WORDS = {}, tokens.WORDS, 50  # generations
    again, _ = e.encode_all(pa.array(many), 7)
    tokens.WORDS = words
    assert (again == ids).all()


def test_counts_equal_library():
    lib = counts._pieces(vocabulary("piece_bpe_32k.model"))
    for t in fuzz(3000, 2):
        got = sum(counts.count_units(vocabulary("piece_bpe_32k.model"), counts.units(t))) if t else 0
        assert got == len(lib.encode(t)), repr(t)


def test_token_counts(spark, docs, rows, no_docs):
    lib = counts._pieces(vocabulary("piece_bpe_32k.model"))
    got = counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), 100).collect()
    want = [(d, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 100) for d, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert counts.token_counts(no_docs, vocabulary("piece_bpe_32k.model"), 100).count() == 0


def test_bucket_of(spark):
    bounds = list(range(0, 1000, 7))
    got = spark.range(-5, 1010).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(b <= r["id"] for b in bounds) for r in got)


def test_running_start(spark, monkeypatch):
    import tracewell.llm.common as common

    monkeypatch.setattr(common, "order_bounds", lambda df, key: [10, 20, 300])
    data = [(i * 7 % 400, i, i % 5, "ab"[i % 2]) for i in range(200)] + [(None, 999, 4, "a")]
    df = spark.createDataFrame(data, "k long, rid long, v long, g string")
    got = {r["rid"]: r["at"] for r in running_start(df, ["k", "rid"], "v", "at", ["g"]).collect()}
    at = defaultdict(int)
    for k, rid, v, g in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        assert got[rid] == at[g]
        at[g] += v


def test_store_round_trip(spark, docs, rows, no_docs):
    e = Encoder(vocabulary("word_bpe_49k.json"))
    path = scratch(spark, "t")
    idstore.write_store(docs, path, vocabulary("word_bpe_49k.json"), 1)
    got = idstore.read_store(spark, path).collect()
    want = Counter((d, tuple([*e.encode(t).tolist(), 1])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    sums = {r["pos"]: tuple(r) for r in idstore.read_store(spark, path, with_ids=False).collect()}
    assert sums == {r["pos"]: (r["doc_id"], r["pos"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got}
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids) and [r["pos"] for r in sorted(got, key=lambda r: r["start"])] == list(range(len(got)))
    chunks = spark.read.parquet(f"{path}/objects/kind=chunk")
    assert chunks.count() == chunks.select("key").distinct().count()
    used = spark.read.parquet(f"{path}/recipes").selectExpr("explode(chunks) c").count()
    assert chunks.count() < used  # copies share chunks
    assert spark.read.parquet(f"{path}/manifest").where("level = 0").selectExpr("sum(documents) n").first()["n"] == len(rows)
    empty = scratch(spark, "t")
    idstore.write_store(no_docs, empty, vocabulary("word_bpe_49k.json"), 1)
    assert idstore.read_store(spark, empty).count() == 0


@pytest.mark.parametrize("harm", ["lost recipes", "doubled recipes", "lost chunks", "swapped chunks", "other manifest"])
def test_store_tells_damage(spark, docs, harm, monkeypatch):
    monkeypatch.setattr(idstore, "BLOCK", 8)
    path, bad = scratch(spark, "t"), scratch(spark, "t")
    idstore.write_store(docs, path, vocabulary("word_bpe_49k.json"), 1)
    assert spark.read.parquet(f"{path}/manifest").agg(F.max("level")).first()[0] > 0
    parts = {k: spark.read.parquet(f"{path}/{k}") for k in ("recipes", "manifest", "objects/kind=chunk")}
    if harm == "lost recipes":
        parts["recipes"] = parts["recipes"].where("pos not between 16 and 23")
    elif harm == "doubled recipes":
        parts["recipes"] = parts["recipes"].union(parts["recipes"].where("pos between 16 and 23"))
    elif harm == "lost chunks":
        parts["objects/kind=chunk"] = parts["objects/kind=chunk"].orderBy("key").limit(5)
    elif harm == "swapped chunks":
        parts["objects/kind=chunk"] = parts["objects/kind=chunk"].withColumn("ids", F.expr("first_value(ids) over (order by key)"))
    else:
        parts["manifest"] = parts["manifest"].withColumn("root", F.when(F.col("block") == 1, F.unhex(F.lit("00"))).otherwise(F.col("root")))
    for k, df in parts.items():
        df.write.parquet(f"{bad}/{k}")
    with pytest.raises(Exception, match="match"):
        idstore.read_store(spark, bad).collect()


def test_cuts_follow_content():
    rnd = np.random.default_rng(2)
    ids = rnd.integers(0, 49000, 20_000).astype("<u4")
    ends = idstore.cuts(len(ids), idstore.candidates(ids).tolist())
    assert ends[-1] == len(ids) and all(b - a <= idstore.MOST for a, b in zip([0, *ends], ends))
    longer = np.concatenate([ids[:50], ids])
    other = idstore.cuts(len(longer), idstore.candidates(longer).tolist())
    shared = {bytes(ids[a:b]) for a, b in zip([0, *ends], ends)} & {bytes(longer[a:b]) for a, b in zip([0, *other], other)}
    assert len(shared) > 0.8 * len(ends)


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 1, "s2": 1}])
def test_packing(spark, docs, rows, no_docs, weights):
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, weights).collect()
    seqs, parts = defaultdict(list), []
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    size = {}
    for s, spans in seqs.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        size[s] = at
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    assert sorted(seqs) == list(range(len(seqs)))
    # each id in exactly one piece: documents come together again
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
    want = Counter((d, tuple([*e.encode(t).tolist(), 0])) for d, t in rows)
    for (d, n), parts in by.items():
        copies = Counter({k: v for k, v in want.items() if k[0] == d and len(k[1]) == n})
        assert sum(p["length"] for p in parts) == n * sum(copies.values())
        if sum(copies.values()) == 1:
            parts.sort(key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in parts) == np.array(next(iter(copies))[1], "<u4").tobytes()
    assert sum(len(k[1]) * v for k, v in want.items()) == sum(size.values())
    whole = {r["sequence_id"]: r["n_tokens"] for r in packing.sequences(packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, weights)).collect()}
    assert whole == size
    assert packing.pack(no_docs, vocabulary("byte_bpe_50k.json"), 0).count() == 0


@pytest.mark.parametrize("weights", [None, [1, 5, 1, 2, 7]])
def test_schedule_is_deficit_round_robin(weights):
    totals = [50_000, 9_000, 1_000, 128, 5]
    s = packing.Schedule(totals, weights)
    slots = sorted((int(r), q) for q in range(5) for r in s.place(q, np.arange(int(s.full[q]))))
    assert [r for r, _ in slots] == list(range(int(sum(s.full))))
    # one queue after the other, with counters in units of 1/sum(weights) ids
    shares, left, counter, order = s.weight.tolist(), s.full.tolist(), [0] * 5, []
    while any(left):
        for q in range(5):
            counter[q] += packing.WINDOW * shares[q]
            while left[q] and counter[q] >= packing.QUANTUM * sum(shares):
                counter[q] -= packing.QUANTUM * sum(shares)
                left[q] -= 1
                order.append(q)
            assert not left[q] or 0 <= counter[q] < packing.QUANTUM * sum(shares)  # the deficit that is carried
    assert [q for _, q in slots] == order


def test_packing_of_many_queues(spark, docs):
    """Places by Spark's counts, as for more queues than a table may have, equal those of the schedule."""
    many = docs.withColumn("source", F.concat("source", (F.col("doc_id") % 5).cast("string")))
    for df, weights in ((docs, None), (docs, {"s0": 5, "s1": 1}), (many, None)):
        one, two = (Counter(map(tuple, packing.pack(df, vocabulary("byte_bpe_50k.json"), 0, weights, False, table).collect())) for table in (4096, 0))
        assert one == two


def by_heap(items, shards):
    """Longest first, one group after another: items (size, key) to shard, and the loads."""
    heap, out = [(0, s) for s in range(shards)], {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out, sorted(load for load, _ in heap)


def test_runs_of_thousands_of_queues_follow_the_documents(spark):
    """As many stretches as quanta, not as rounds that pass between them, at the places of the closed form."""
    rnd = random.Random(3)
    totals = [rnd.randint(1, 900) for _ in range(5000)]
    totals[7] = 3_000_000
    rows, at = [], [0] * 5000
    for q in (0, 7, 7, 7, 4999):
        n = totals[q] - at[q] if q != 7 or at[q] > 2_000_000 else 1_200_000
        rows.append((len(rows), q, at[q], n))
        at[q] += n
    # the queues' order is that of their numbers in both
    weights = packing.scaled(totals)
    plan = spark.createDataFrame([(f"k{q}", q, n, w) for q, (n, w) in enumerate(zip(totals, weights))], "queue string, q long, n long, weight long")
    slim = spark.createDataFrame([(r, f"k{q}", a, n) for r, q, a, n in rows], "rid long, queue string, at long, n long")
    got = {r["rid"]: [(x["start"], x["length"], x["to"]) for x in r["runs"]] for r in packing._ranked_runs(slim, plan).collect()}
    # the same counts for queues of which no document is asked: each of them has its turns
    schedule = packing.Schedule(totals)
    assert sum(map(len, got.values())) <= sum(n // packing.QUANTUM + 2 for *_, n in rows)
    for r, q, a, n in rows:
        assert [x[0] for x in got[r]] == sorted(x[0] for x in got[r]) and sum(x[1] for x in got[r]) == n
    assert schedule.slots == sum(t // packing.QUANTUM for t in totals)


def test_turns_equal_a_heap():
    rnd = random.Random(11)
    for case in range(300):
        shards, classes = rnd.choice([1, 2, 3, 7, 16]), {rnd.randint(1, 50) * rnd.choice([1, 1, 40]): rnd.choice([1, 2, 5, 60]) for _ in range(rnd.randint(1, 12))}
        items = [(size, (size, k)) for size, n in classes.items() for k in range(n)]
        want, loads = by_heap(items, shards)
        got = {}
        for size, parts in sharding.schedule(list(classes.items()), shards):
            ends = [a for a, _ in parts[1:]] + [classes[size]]
            for (a, pattern), b in zip(parts, ends):
                got |= {(size, k): pattern[(k - a) % len(pattern)] for k in range(a, b)}
        assert got == want, (case, shards, classes)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_sharding(spark, docs, rows, no_docs, limit, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST", limit)
    monkeypatch.setattr(sharding, "MANY", 2)
    many = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 5000, "text": F.substring("text", 1, 7)}))
    for df in (docs, many):
        source = df.select("doc_id", "text").collect()
        got = sharding.assign(df, 4).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
        sizes, by, slots = Counter(), defaultdict(set), defaultdict(list)
        for r in got:
            sizes[bytes(r["group"])] += r["size"]
            by[bytes(r["group"])].add(r["shard"])
            slots[r["shard"]].append((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1))
        h = {bytes(r[0]): r[1] for r in spark.createDataFrame([(bytearray(g),) for g in sizes], "g binary").select("g", F.xxhash64("g")).collect()}
        want, _ = by_heap([(n, (h[g], g)) for g, n in sizes.items()], 4)
        assert by == {g: {want[h[g], g]} for g in sizes}
        for s in slots.values():
            s.sort()
            assert [x for x, _ in s] == list(range(len(s))) and [d for _, d in s] == sorted(d for _, d in s)
    assert sharding.assign(no_docs, 4).count() == 0


def test_running_start_of_a_hot_key(spark, monkeypatch):
    import tracewell.llm.common as common

    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(common.order_bounds, "__defaults__", (10,))
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i, i % 5) for i in range(300)]
    got = {r["rid"]: r["at"] for r in running_start(spark.createDataFrame(data, "k long, rid long, v long"), ["k", "rid"], "v", "at").collect()}
    at = 0
    for _, rid, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        assert got[rid] == at
        at += v
