"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits; bit k is set if more than half of the XXH64 hashes (seed 42) of the
shingles, repeats included, have it set. Of two fingerprints within the budget of BUDGET bits, at
least one of BUDGET + 1 equal blocks of bits agrees. So the distinct fingerprints form that many
binary tries, each rotated to begin with another block; a trie is joined with itself from the nodes
below its first block, where no bit may differ: each step down adds the bits in which the two paths
differ and drops the pair beyond the budget. Each fingerprint is sent once a trie. Nodes of over NODE
fingerprints are walked on by Spark first, so a dense region is split by its own bits; smaller ones
go to tasks, which walk on to the leaves and compare what is left exactly.

Within a task a pair of nodes is also dropped once all its fingerprints are known to be connected
(budgets 0 to 3 are walked in turn, nearest links first), and the task returns a spanning forest of
its links: at most one link a fingerprint, however large a group of near copies is.

Defined results: a null text has no words, so fingerprint zero, which links like any other; copies
and repeated rows share a fingerprint and a component; component_id ignores null doc_ids, and is
null where a component has no other; an empty table gives an empty result; further columns are
ignored. Whole texts are hashed, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import in_tasks, staged
from tracewell.llm.components import components

SEED, BITS, BUDGET = 42, 64, 3
#: Fingerprints of a trie node that a task may get on either side of a pair.
NODE = 2048
#: Fingerprints that a task gets about, of many small nodes.
CELL = 16_384
#: Pairs of fingerprints below a pair of nodes that are compared directly.
LEAF = 64

_LOWER = {i: i + 32 for i in range(65, 91)}
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_BLOCK = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text over shingles of ``words`` words."""
    w = _WORDS.findall(text.translate(_LOWER)) if text else []
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        stop = min(n, at + _BLOCK)
        rows = zip(*(w[at + k : stop + k] for k in range(words))) if len(w) >= words else [w]
        h = np.array([digest(" ".join(x), SEED) for x in rows], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, t (hash of the text) and fp (the fingerprint as a signed long) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))

    def make():
        def run(batch: dict) -> Iterator[dict]:
            fps = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64).astype(np.int64)
            yield {"doc_id": batch["doc_id"], "t": batch["t"], "fp": fps.tolist()}

        return run

    return in_tasks(rows, make, "doc_id long, t long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def trie_links(fps: np.ndarray, starts: np.ndarray, depth: int, budget: int = BUDGET) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted unsigned ``fps``.

    starts: pairs of nodes to walk, as rows (lo_a, hi_a, lo_b, hi_b) of ranges of ``fps`` whose paths
    of ``depth`` bits end in that node. All levels of all pairs are walked as arrays.
    """
    n = len(fps)
    parent = np.arange(n)
    forest: list[tuple[int, int]] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = _find(parent, x), _find(parent, y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                forest.append((x, y))

    def settle() -> tuple[np.ndarray, np.ndarray]:
        """Least root and change count by position, to tell whether a range is one component."""
        nonlocal parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        return parent, np.concatenate([[0], np.cumsum(np.diff(parent) != 0)]) if n else parent

    for most in range(1, budget + 1):
        root, change = settle()
        a0, a1, b0, b1 = starts.T
        left = np.full(len(a0), most) - (_popcount((fps[a0] ^ fps[b0]) >> np.uint64(BITS - depth)).astype(np.int64) if depth else 0)
        live = left >= 0
        a0, a1, b0, b1, left = a0[live], a1[live], b0[live], b1[live], left[live]
        for d in range(depth, BITS + 1):
            if not len(a0):
                break
            # all of both nodes in one component already: nothing to find below
            done = (root[a0] == root[b0]) & (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0])
            small = ~done & (((a1 - a0) * (b1 - b0) <= LEAF) | (d == BITS))
            if small.any():
                for at in range(0, int(small.sum()), 50_000):
                    s0, s1, t0, t1 = (x[small][at : at + 50_000] for x in (a0, a1, b0, b1))
                    w = t1 - t0
                    m = (s1 - s0) * w
                    pair = np.repeat(np.arange(len(m)), m)
                    k = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
                    x, y = s0[pair] + k // w[pair], t0[pair] + k % w[pair]
                    ok = (x != y) & (_popcount(fps[x] ^ fps[y]) <= most)
                    join(x[ok], y[ok])
            go = ~done & ~small
            a0, a1, b0, b1, left = a0[go], a1[go], b0[go], b1[go], left[go]
            if not len(a0) or d == BITS:
                break
            # the border between a node's children: the first fingerprint with the next bit set
            bit = np.uint64(1) << np.uint64(BITS - 1 - d)
            below = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(BITS - d) if d else np.uint64(0)
            am = np.searchsorted(fps, (fps[a0] & below) | bit)
            bm = np.searchsorted(fps, (fps[b0] & below) | bit)
            same = a0 == b0
            parts = [(a0, am, b0, bm, left), (am, a1, bm, b1, left), (a0, am, bm, b1, left - 1), (np.where(same, 0, am), np.where(same, 0, a1), b0, bm, left - 1)]
            a0, a1, b0, b1, left = (np.concatenate([p[i] for p in parts]) for i in range(5))
            keep = (a0 < a1) & (b0 < b1) & (left >= 0)
            a0, a1, b0, b1, left = a0[keep], a1[keep], b0[keep], b1[keep], left[keep]
    return forest


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")


def _rotated(fp: Column, by: int) -> Column:
    """The bits of a long, the first ``by`` moved to the end."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def _task_links(budget: int):
    def links(key, pdf):
        import pandas as pd

        by, depth = int(key[0]), int(key[1])
        fps = np.unique(pdf["fp"].to_numpy().astype(np.uint64))
        tops = fps >> np.uint64(BITS - depth)
        nodes = np.unique(pdf[["own", "node"]].to_numpy().astype(np.uint64), axis=0)
        ends = [np.searchsorted(tops, nodes[:, c], side) for c in (0, 1) for side in ("left", "right")]
        starts = np.stack(ends, 1).astype(np.int64)
        got = trie_links(fps, starts[(starts[:, 0] < starts[:, 1]) & (starts[:, 2] < starts[:, 3])], depth, budget)
        back = (fps >> np.uint64(by)) | (fps << np.uint64(BITS - by)) if by else fps
        signed = back.astype(np.int64)
        return pd.DataFrame({"a": [signed[x] for x, _ in got], "b": [signed[y] for _, y in got]}).astype("int64")

    return links


def links(fps: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """Links (a, b) that connect the distinct ``fps`` (fp) exactly as all pairs within the budget do."""
    blocks, step, final = budget + 1, 4, []
    depth = BITS // blocks
    # cells: nodes with equal first bits, as many as a task should get at once
    bits = max(4, min(depth, (fps.count() // CELL).bit_length()))
    turned = F.explode(F.array(*[F.struct(F.lit(depth * k).alias("by"), _rotated(F.col("fp"), depth * k).alias("fp")) for k in range(blocks)]))
    fps = fps.select(turned.alias("x")).select("x.by", "x.fp")
    pairs = fps.groupBy("by", _prefix(F.col("fp"), depth).alias("p")).agg(F.count("*").alias("n")).where("n > 1")
    pairs = pairs.select("by", "p", "n", F.col("p").alias("q"), F.col("n").alias("m"))
    while True:
        deep = (F.col("n") > node) | (F.col("m") > node)
        pairs = staged(pairs.select("by", "p", "n", "q", "m"), "trie")
        last = depth + step > BITS
        final.append((depth, (pairs if last else pairs.where(~deep)).select("by", "p", "q")))
        if last or not pairs.where(deep).limit(1).count():
            break
        up, parents, depth = depth, pairs.where(deep), depth + step
        wanted = parents.select("by", F.col("p").alias("up")).union(parents.select("by", "q")).distinct()
        below = fps.select("by", "fp", _prefix(F.col("fp"), up).alias("up")).join(wanted, ["by", "up"], "left_semi")
        child = staged(below.groupBy("by", "up", _prefix(F.col("fp"), depth).alias("p")).agg(F.count("*").alias("n")), "trie")
        a = child.select("by", F.col("up").alias("a_up"), "p", "n")
        b = child.select("by", F.col("up").alias("b_up"), F.col("p").alias("q"), F.col("n").alias("m"))
        pairs = parents.select("by", F.col("p").alias("a_up"), F.col("q").alias("b_up")).join(a, ["by", "a_up"]).join(b, ["by", "b_up"])
        pairs = pairs.where((F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= budget) & ((F.col("a_up") != F.col("b_up")) | (F.col("p") <= F.col("q"))))
    out = None
    for depth, pq in final:
        at = fps.select("by", _prefix(F.col("fp"), depth).alias("node"), "fp")
        if depth == final[0][0]:  # nodes with themselves
            rows = at.join(pq.select("by", F.col("p").alias("node")), ["by", "node"]).select("by", F.col("node").alias("own"), "node", "fp")
        else:
            # the node that a pair goes to is drawn by hash, so that low prefixes get no more pairs
            swap = F.pmod(F.xxhash64("p", "q"), F.lit(2)) == 0
            own = pq.select("by", F.when(swap, F.col("p")).otherwise(F.col("q")).alias("own"), F.when(swap, F.col("q")).otherwise(F.col("p")).alias("node"))
            # the own node's fingerprints come along as its pair with itself, which is a pair of this or an upper level
            rows = own.union(own.select("by", "own", F.col("own").alias("node"))).distinct().join(at, ["by", "node"]).select("by", "own", "node", "fp")
        cell = F.shiftrightunsigned("own", depth - bits) if depth == final[0][0] else F.col("own")
        rows = rows.select("by", F.lit(depth).alias("depth"), cell.alias("cell"), "own", "node", "fp")
        out = rows if out is None else out.union(rows)
    return out.groupBy("by", "depth", "cell").applyInPandas(_task_links(budget), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, t, fp, component_id, root for each row of ``docs`` (doc_id, text).

    component_id: the least doc_id reachable over links; root: a fingerprint that stands for the component.
    """
    rows = staged(fingerprints(docs, words), "simhash")
    each = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    roots = components(links(each.select("fp")))
    each = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    each = staged(each, "simhash")
    ids = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(each.join(ids, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "t", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows of ``docs``, with all their columns: of each component the one with the least doc_id.

    Ties go to the least hash of the text; of rows equal in both, one stays. Rows to drop are told by
    (doc_id, t); their table is broadcast only below 200,000 rows.
    """
    rows = staged(near_duplicates(docs, words), "groups")
    return best_rows(docs, rows, rows.groupBy("root").agg(F.min(rank()).alias("best")))


def rank() -> Column:
    """Order in which rows (doc_id, t) are preferred: nulls are the last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")


def best_rows(docs: DataFrame, rows: DataFrame, best: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are the ``best`` (root, best: a rank or null) of their root in ``rows`` (doc_id, t, root)."""
    each = rows.groupBy("root", "doc_id", "t").agg(F.count("*").alias("times")).join(best, "root")
    each = staged(each.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("t").eqNullSafe(F.col("best.t")) & F.col("best").isNotNull()).alias("_keep"), "times"), "groups")

    def small(keys: DataFrame) -> DataFrame:
        keys = keys.select("_d", "_t")
        return F.broadcast(keys) if keys.limit(200_001).count() <= 200_000 else keys

    mine = docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("_t"))
    repeated = each.where("_keep and times > 1")
    if not repeated.limit(1).count():
        return docs.join(small(each.where("not _keep")), mine, "left_anti")
    once = docs.join(small(each.where("not _keep or times > 1")), mine, "left_anti")
    return once.union(docs.join(small(repeated), mine, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all of ``documents``."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
