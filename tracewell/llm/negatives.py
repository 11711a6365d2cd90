"""Hard negatives by Fagin's threshold algorithm.

Vectors are dealt by hash into blocks of about BLOCK rows, anchors into blocks of about ANCHORS; a task gets one
of each. It sorts the candidates of each dimension, and for every anchor goes down these lists, from the end that
the sign of the anchor's component asks for: DEPTH rows of each list, then twice as many. Each row that is new is
scored in full by integers (random access). The threshold is the score of a row that stands in every list where the
walk has come to; no row unseen can score more, so the walk ends once it is strictly below the k-th score of
each window (ties go to the smaller vec_id, so a row unseen with an equal score could still come first), or below
what the window takes at least. That finds

  1. positives: the POSITIVES best rows of the anchor's label, in lists of that label alone;
  2. negatives: for each positive the NEGATIVES best rows of other labels whose score is within the window that
     the positive's score sets.

The first rows of each block meet by anchor (and positive) in a ranking that Spark cuts to k rows a task first.
Each anchor is held against all rows, in blocks: traffic is rows * anchor blocks + anchors * row blocks.

Defined results: rows with a null label or vector, or a null or non-finite component take no part; an empty vector
scores 0; of vectors of unequal length the shorter is continued by zeros; a null vec_id is no anchor, is not
divisible by 7 and comes last among equal scores. An anchor's other rows are those of other vec_ids; repeated anchor
rows are mined once, repeated rows among the others take a place each. Scores are exact while they fit in 63 bits,
and go to the end of that range beyond. An anchor without positives, or a positive whose window has no row, has no
rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import staged

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is within these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows and anchors of a block on average.
BLOCK, ANCHORS = 16_384, 1024
#: Rows of each list in the first step of a walk.
DEPTH = 16
#: Stands for a null vec_id, so that it comes last.
_LAST = np.iinfo(np.int64).max
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` integers from lists, which zeros continue."""
    lists = column.combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    values, out = np.asarray(lists.flatten()), np.zeros((len(lists), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


class Lists:
    """Candidates sorted by each dimension. x: a row of integers for each; ids: their vec_ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(x, self.order.T, axis=0).T
        self.most = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.most * np.abs(a).max(initial=0) < _EXACT:
            return (self.x[rows] @ a).astype(np.int64)
        exact = self.x[rows].astype(object)  # whole numbers of any size
        total = [sum(int(p) * int(q) for p, q in zip(r, a)) for r in exact]
        return np.array([min(max(t, -(2**63)), 2**63 - 1) for t in total], np.int64)

    def walk(self, a: np.ndarray, usable: np.ndarray, stop: Callable[[np.ndarray, np.ndarray, float], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the first for anchor ``a``, of those ``usable``, with their scores.

        stop: told all rows and scores found so far and the threshold, says whether no unseen row matters.
        """
        n, dims = self.x.shape[0], np.flatnonzero(a)
        up = a[dims] > 0  # from the largest down, else from the smallest up
        new, depth, at = usable.copy(), DEPTH, 0
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while at < n:
            to = min(n, at + depth) if len(dims) else n
            seen = np.zeros(n, bool)
            if to == n:
                seen[:] = True
            else:
                seen[self.order[dims[up], n - to : n - at]] = True
                seen[self.order[dims[~up], at:to]] = True
            found = np.flatnonzero(seen & new)
            new[found] = False
            rows.append(found)
            scores.append(self.scores(found, a))
            at, depth = to, 2 * depth
            if at < n:
                ends = np.where(up, self.values[dims, n - at], self.values[dims, at - 1])
                threshold = float(np.dot(ends, a[dims]))
                if abs(threshold) >= _EXACT:
                    threshold = float(np.nextafter(threshold * (1 + 1e-12), np.inf)) if threshold > 0 else threshold * (1 - 1e-12)
                if stop(np.concatenate(rows), np.concatenate(scores), threshold):
                    break
        return np.concatenate(rows), np.concatenate(scores)


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in order."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= kth)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def window_of(score: int) -> tuple[int, int]:
    """Least and greatest score of negatives for a positive's."""
    return -(-LEAST * score // 100), MOST * score // 100


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(_LAST).to_numpy().astype(np.int64)


def _blocks(candidates: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = [int(np.diff(np.asarray(t["v"].combine_chunks().offsets)).max(initial=0)) for t in (candidates, anchors)]
    dims = max(sizes)
    return matrix(candidates["v"], dims), _ids(candidates["vec_id"]), candidates["label"].to_numpy(), matrix(anchors["v"], dims), _ids(anchors["vec_id"]), anchors["label"].to_numpy()


def _nulls(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == _LAST)


def _positives(k: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("anchor", "other", "score")}
        if candidates.num_rows and anchors.num_rows:
            x, ids, labels, a, own, label = _blocks(candidates, anchors)
            for value in np.unique(label):
                rows = np.flatnonzero(labels == value)
                lists = Lists(x[rows], ids[rows])
                for i in np.flatnonzero(label == value).tolist():
                    got, scores = lists.walk(a[i], lists.ids != own[i], lambda r, s, t: len(s) >= k and t < np.partition(s, len(s) - k)[len(s) - k])
                    best = first(lists.ids[got], scores, k)
                    out["anchor"].append(np.full(len(best), anchors["anchor"][i].as_py()))
                    out["other"].append(lists.ids[got[best]])
                    out["score"].append(scores[best])
        anchor, other, score = (np.concatenate(out[c]).astype(np.int64) for c in ("anchor", "other", "score"))
        return pa.table({"anchor": anchor, "other": _nulls(other), "score": score})

    return run


def _within(ids: np.ndarray, scores: np.ndarray, window: tuple[int, int], k: int) -> np.ndarray:
    inside = np.flatnonzero((scores >= window[0]) & (scores <= window[1]))
    return inside[first(ids[inside], scores[inside], k)]


def _negatives(k: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [np.zeros((0, 4), np.int64)]
        if candidates.num_rows and anchors.num_rows:
            x, ids, labels, a, _, label = _blocks(candidates, anchors)
            lists = Lists(x, ids)
            for i, positives in enumerate(anchors["positives"].to_pylist()):
                windows = {p: window_of(p) for p in positives}

                def stop(rows: np.ndarray, scores: np.ndarray, threshold: float) -> bool:
                    for least, greatest in windows.values():
                        if threshold >= least:
                            inside = scores[(scores >= least) & (scores <= greatest)]
                            if len(inside) < k or threshold >= np.partition(inside, len(inside) - k)[len(inside) - k]:
                                return False
                    return True

                got, scores = lists.walk(a[i], labels != label[i], stop)
                for p, window in windows.items():
                    best = _within(ids[got], scores, window, k)
                    out.append(np.column_stack([np.full(len(best), anchors["anchor"][i].as_py()), np.full(len(best), p), ids[got[best]], scores[best]]))
        all_ = np.concatenate(out).astype(np.int64)
        return pa.table({"anchor": all_[:, 0], "positive_score": all_[:, 1], "other": _nulls(all_[:, 2]), "score": all_[:, 3]})

    return run


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (floor of 256 times each component, as doubles) of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # rint of what is whole already: floor() would give a long, which large components don't fit
    whole = F.transform("e", lambda x: F.rint(x * 256) - F.when(F.rint(x * 256) > x * 256, 1.0).otherwise(0.0))
    return rows.where(F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad).select("vec_id", label.alias("label"), whole.alias("v"))


def _met(candidates: DataFrame, anchors: DataFrame, blocks: int, found, schema: str) -> DataFrame:
    """Every block of ``candidates`` (block, ...) with every one of ``anchors`` (deal, ...)."""
    deals = max(1, -(-anchors.count() // ANCHORS))
    here = candidates.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    there = anchors.withColumn("deal", F.pmod(F.xxhash64("anchor"), F.lit(deals)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return here.groupBy("block", "deal").cogroup(there.groupBy("block", "deal")).applyInArrow(found, schema)


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of ``embeddings``
    (vec_id, embedding, label) whose vec_id is divisible by ``every``, and each of its positives.
    """
    rows = staged(scaled(embeddings).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).select("block", "vec_id", "label", "v")
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"]).drop("block")
    anchors = staged(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    best = _met(rows, anchors, blocks, _positives(positives), "anchor long, other long, score long")
    order = [F.col("score").desc(), F.col("other").asc_nulls_last()]
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    best = staged(best.select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    with_windows = anchors.join(best.groupBy("anchor").agg(F.collect_set("positive_score").alias("positives")), "anchor")
    found = _met(rows, with_windows, blocks, _negatives(negatives), "anchor long, positive_score long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(*order))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return (
        found.join(best, ["anchor", "positive_score"])
        .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all of ``embeddings``."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::double)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_inner_product(a.v, b.v)::bigint AS score FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::int AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""
