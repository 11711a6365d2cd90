"""One of each group of similar documents: Jaccard similarity of the sets of five-word shingles, 0.8 or more.

A document is dropped if and only if a kept one before it (by doc_id) is that similar, so what is
dropped has its like in the result, and no chain of links drops a document far from the kept one.

Candidates share a bucket: a component of the SimHash trie over five-word fingerprints, or one of
BANDS keys made of ROWS minima of permuted shingle hashes each. At similarity 0.8 SimHash differs in
about 10 of 64 bits, far beyond any budget that the trie can walk, so the bands find those: a pair at
0.8 shares none with a chance of (1 - 0.8**5)**24, 1 in 14,000, and one at 0.85 of 1 in 1,300,000.
Each candidate pair is then checked by the sizes of the two sets and of what they have in common.

Rounds: in each bucket the first documents left (HEADS, and in each round twice as many) are compared
with all after them, and those whose comparisons are complete are decided in order. So a bucket of many
near copies costs a few comparisons a document, not all pairs, and none is left out. A bucket that is not
settled by FEW first documents holds many that are not similar (a template, a passage that all have). What is
left is then dealt anew by prefixes: a set of n shingles that is similar to another shares one of its n - 0.8 n + 1
rarest shingles with it, so only these are buckets. Common passages are in no prefix, and no pair is lost. The
order of shingles by rarity takes the COMMON most frequent ones among what is left last; any order would do, this
one is short enough to be sent to the tasks.

Documents with equal sets of shingles, so all copies, are one node. A text below five words is one
shingle; null and blank texts have none and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import in_tasks, staged
from tracewell.llm.components import components
from tracewell.llm.simhash import _LOWER, _WORDS, BITS, SEED, best_rows, links, rank

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
HEADS, FEW = 2, 4
#: Pairs for each row of the prefixes' buckets up to which all are tried in one round; the result is the same.
AT_ONCE = 16
#: Most frequent shingles that prefixes avoid.
COMMON = 65_536

_ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included."""
    w = _WORDS.findall(text.translate(_LOWER)) if text else []
    if not w:
        return np.zeros(0, np.uint64)
    rows = zip(*(w[k:] for k in range(WORDS))) if len(w) >= WORDS else [w]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(" ".join(x), SEED) for x in rows), np.uint64, max(1, len(w) - WORDS + 1))


def simhash(hashes: np.ndarray) -> int:
    """SimHash of the hashes of shingles, as in simhash.py."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096].astype(">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def bands(distinct: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes that is not empty."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(distinct), 1024):
        h = distinct[None, at : at + 1024]
        np.minimum(least, ((h ^ _ODD[0][:, None]) * _ODD[1][:, None]).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, t, fp, root (hash of the set of shingles), n (its size), bands of each row of ``docs``."""

    def make():
        def run(batch: dict) -> Iterator[dict]:
            out = []
            for text in batch["text"]:
                h = shingles(text)
                d = np.unique(h)
                root = int(np.array(xxhash.xxh64_intdigest(d.tobytes(), 42), np.uint64).astype(np.int64))
                out.append((int(np.array(simhash(h), np.uint64).astype(np.int64)), root, len(d), bands(d).astype(np.int64).tolist() if len(d) else []))
            yield {"doc_id": batch["doc_id"], "t": batch["t"], **dict(zip(("fp", "root", "n", "bands"), map(list, zip(*out))))} if out else {k: [] for k in ("doc_id", "t", "fp", "root", "n", "bands")}

        return run

    return in_tasks(_texts(docs), make, "doc_id long, t long, fp long, root long, n long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes (its distinct shingles) of ``nodes`` (node, k), from one text of each."""

    def make():
        def run(batch: dict) -> Iterator[dict]:
            for at in range(0, len(batch["node"]), 100):
                yield {"node": batch["node"][at : at + 100], "hashes": [np.unique(shingles(t)).astype(np.int64) for t in batch["text"][at : at + 100]]}

        return run

    key = nodes.select("node", F.col("k.doc_id").alias("_d"), F.col("k.t").alias("_t"))
    rows = _texts(docs)
    rows = rows.join(key, rows["t"].eqNullSafe(key["_t"]) & rows["doc_id"].eqNullSafe(key["_d"])).select("node", "text")
    return in_tasks(rows, make, "node long, hashes array<long>").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) that are similar enough, by whole sets."""
    x, y = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    # in integers, so that a pair at exactly 0.8 is in
    enough = both * 10 >= (F.size("ha") + F.size("hb") - both) * int(LEAST * 10)
    return pairs.join(x, "a").join(y, "b").where(enough).select(*pairs.columns)


def similar_to_kept(docs: DataFrame, rows: DataFrame, heads: int = HEADS) -> DataFrame:
    """node: roots of ``rows`` (as _described gives them) that are to be dropped."""
    nodes = rows.groupBy("root").agg(F.min(rank()).alias("k"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = staged(nodes.withColumnRenamed("root", "node").where("n > 0"), "nodes")
    trie = components(links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    by_trie = nodes.join(trie, "fp", "left").select(F.coalesce("root", "fp").alias("bucket"), F.lit(True).alias("trie"), "node", "k", "n", F.lit(0).alias("pos"))
    left = by_trie.union(nodes.select(F.explode("bands").alias("bucket"), F.lit(False), "node", "k", "n", F.lit(0)))
    left = _shared(left)
    sets = staged(_sets(docs, left.select("node", "k").distinct()), "sets")
    dropped, prefixes = None, False
    while left.limit(1).count():
        if heads > FEW and not prefixes:
            left, prefixes = _shared(_by_prefix(left.select("node", "k", "n").distinct(), sets)), True
            n = F.col("count")
            pairs, rows, most = left.groupBy("bucket").count().agg(F.sum(n * (n - 1) / 2), F.sum(n), F.max(n)).first()
            heads = most if pairs is not None and pairs <= AT_ONCE * rows else FEW
            continue
        at = Window.partitionBy("trie", "bucket").orderBy("k")
        seen = staged(left.withColumn("rn", F.row_number().over(at)), "similar")
        first = seen.where(F.col("rn") <= heads).select("trie", "bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rn").alias("ra"), F.col("pos").alias("pa"))
        later = seen.select("trie", "bucket", F.col("node").alias("b"), F.col("n").alias("nb"), "rn", F.col("pos").alias("pb"))
        sizes = (F.col("na") * 10 >= F.col("nb") * int(LEAST * 10)) & (F.col("nb") * 10 >= F.col("na") * int(LEAST * 10))
        # what two sets have in common from a shared shingle on, if it is the first, is at most what either has left
        rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * int(LEAST * 10 + 10) >= (F.col("na") + F.col("nb")) * int(LEAST * 10)
        pairs = staged(first.join(later, ["trie", "bucket"]).where((F.col("ra") < F.col("rn")) & sizes & rest).select("a", "b").distinct(), "similar")
        # a node is ready if it has been compared with every node before it, and it with all after it
        ready = staged(seen.groupBy("node").agg((F.max("rn") <= heads).alias("ready")).where("ready").select("node"), "similar")
        edges = staged(_similar(pairs, sets).join(ready.select(F.col("node").alias("a"), F.lit(True).alias("ready")), "a", "left"), "similar")
        gone = []
        while True:
            kept = edges.where("ready").select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
            out = staged(edges.join(kept, "a", "left_semi").select("b").distinct(), "similar")
            if not out.limit(1).count():
                break
            gone.append(out.select(F.col("b").alias("node")))
            # links of dropped nodes say nothing more; those of kept ones end in dropped ones
            edges = staged(edges.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti"), "similar")
        for g in gone:
            dropped = g if dropped is None else dropped.union(g)
        decided = ready.join(edges.select(F.col("b").alias("node")), "node", "left_anti")
        for g in gone:
            decided = decided.union(g)
        heads *= 2
        left = _shared(left.join(decided.distinct(), "node", "left_anti").select("bucket", "trie", "node", "k", "n", "pos"))
    return dropped if dropped is not None else nodes.select("node").limit(0)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of a set of n hashes the n - 0.8 n + 1 rarest: those of ``common`` (ascending) are the last, by their places there."""
    n = len(hashes)
    at = np.minimum(np.searchsorted(common["h"], hashes), max(0, len(common) - 1))
    last = np.where(common["h"][at] == hashes, common["n"][at], 0) if len(common) else np.zeros(n, np.int64)
    return hashes[np.lexsort((hashes, last))][: n - -(-n * int(LEAST * 10) // 10) + 1]


def _by_prefix(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, trie, node, k, n, pos (from 0): a row for each shingle in the prefix of each of ``nodes`` (node, k, n)."""
    own = staged(sets.join(nodes, "node").select("node", "k", "n", "hashes"), "prefix")
    often = own.select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") > 1).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    common = np.array(sorted((r[0], r[1]) for r in often), [("h", np.int64), ("n", np.int64)])
    shared = nodes.sparkSession.sparkContext.broadcast(common)

    def make():
        def run(batch: dict) -> Iterator[dict]:
            for at in range(0, len(batch["node"]), 200):
                part = {c: batch[c][at : at + 200] for c in ("node", "k", "n", "hashes")}
                found = [prefix(np.array(h, np.int64), shared.value) for h in part["hashes"]]
                own = np.repeat(np.arange(len(found)), [len(x) for x in found]).tolist()
                yield {"bucket": np.concatenate([np.zeros(0, np.int64), *found]), "trie": [False] * len(own), "pos": np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in found)]), **{c: [part[c][i] for i in own] for c in ("node", "k", "n")}}

        return run

    k = own.schema["k"].dataType.simpleString()
    return in_tasks(own, make, f"bucket long, trie boolean, node long, k {k}, n long, pos int", 500)


def _shared(left: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one node."""
    left = staged(left, "buckets")
    many = left.groupBy("trie", "bucket").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return staged(left.join(many, ["trie", "bucket"]).select("bucket", "trie", "node", "k", "n", "pos"), "buckets")


def one_of_similar(docs: DataFrame, heads: int = HEADS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...), with all their columns, none similar to a kept one before it.

    Order: by doc_id, nulls last, then by the hash of the text; of equal rows one stays.
    """
    rows = staged(_described(docs), "described")
    dropped = staged(similar_to_kept(docs, rows, heads).distinct(), "dropped").select(F.col("node").alias("root"), F.lit(True).alias("gone"))
    best = rows.groupBy("root").agg(F.min(rank()).alias("best")).join(dropped, "root", "left")
    return best_rows(docs, rows.select("doc_id", "t", "root"), best.select("root", F.when(F.col("gone").isNull(), F.col("best")).alias("best")))
