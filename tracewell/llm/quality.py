"""Quality classifier: a sparse ensemble of rules.

Statistics of a text (shares of kinds of characters, word lengths, repetition, line shape) feed
small boosted trees; every path of a tree, cut at any length, is a conjunctive rule such as
``upper > 0.3 and distinct_words <= 0.5``. A lasso-penalised logistic regression gives most rules
weight zero; the others, with their weights, are compiled into one Spark column expression.

Fitting uses at most SAMPLE labelled rows, those whose ids hash lowest (a bound, not a share of the
input); their statistics are made by Spark. Scoring covers every whole text.

Defined results: a null text is the empty one and is scored like any text; without labelled rows, or
with rows of one label only, no rule can be learnt and every score is the share of label 1, or 1.0;
repeated labels each count; repeated documents each get their score; a null doc_id is never held
out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import batches_bounded, in_tasks

SAMPLE, THRESHOLD = 8000, 0.7
TREES, DEPTH, BINS = 40, 3, 32
STATISTICS = ("chars", "words", "word_len", "long_words", "upper", "digits", "punctuation", "symbols", "other", "spaces", "lines", "line_len", "distinct_words", "top_word", "top_run", "repeated_lines", "ends", "bang", "bars", "short_words", "capital_words", "urls", "entropy")

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)]) & ~_PUNCTUATION
_CODES = np.arange(256)
_UPPER, _DIGIT, _HIGH = (_CODES >= 65) & (_CODES <= 90), (_CODES >= 48) & (_CODES <= 57), _CODES >= 128
_URL = re.compile(r"https?://|www\.")


def statistics(text: str | None) -> tuple[float, ...]:
    """STATISTICS of a whole text."""
    text = text or ""
    n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = max(1, int(n.sum()))
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    run = best = 0
    last = None
    for w in words:
        run = run + 1 if w == last else 1
        last = w
        best = max(best, run)
    capital = sum(1 for w in counts if w[0].isupper())
    p = n[n > 0] / total
    return tuple(
        float(x)
        for x in (
            np.log1p(len(text)), np.log1p(len(words)), length.mean() if len(words) else 0, (length > 20).sum() / k, n[_UPPER].sum() / total, n[_DIGIT].sum() / total,
            n[_PUNCTUATION].sum() / total, n[_SYMBOL].sum() / total, n[_HIGH].sum() / total, n[[9, 10, 13, 32]].sum() / total, np.log1p(len(lines)), np.log1p(len(text) / len(lines)),
            len(counts) / k, max(counts.values(), default=0) / k, best / k, 1 - len(set(lines)) / len(lines), n[46] / k, n[33] / k, n[124] / k, (length <= 2).sum() / k,
            capital / max(1, len(counts)), len(_URL.findall(text)) / k, -(p * np.log2(p)).sum(),
        )
    )


def with_statistics(rows: DataFrame) -> DataFrame:
    """doc_id (long), and STATISTICS as doubles, of each of ``rows`` (doc_id, text)."""

    def make():
        def run(batch: dict) -> Iterator[dict]:
            got = [statistics(t) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"]} | {f"s_{name}": [g[i] for g in got] for i, name in enumerate(STATISTICS)}

        return run

    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_tasks(slim, make, "doc_id long, " + ", ".join(f"s_{name} double" for name in STATISTICS))


#: A condition: statistic, True for "greater than", bound.
Condition = tuple[str, bool, float]


@dataclass
class Rules:
    """Rules with their weights; the score is the logistic function of intercept plus weights of rules that hold."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self, of: Callable[[str], Column] = lambda name: F.col(f"s_{name}")) -> Column:
        """The score as a column expression over statistics, ``of`` a name; by default the s_ columns."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = None
            for name, above, bound in conditions:
                c = of(name) > F.lit(bound) if above else of(name) <= F.lit(bound)
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, depth: int, features: np.ndarray, out: list, step: np.ndarray) -> None:
    """Grows a regression tree on binned statistics; adds each node's path to ``out`` and leaf values to ``step``."""
    if path:
        out.append(path)
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-3, None, None)
    if depth and len(rows) >= 20:
        for f in features:
            gs = np.bincount(x[rows, f], gradient[rows], BINS + 1).cumsum()
            hs = np.bincount(x[rows, f], hessian[rows], BINS + 1).cumsum()
            ns = np.bincount(x[rows, f], minlength=BINS + 1).cumsum()
            ok = (ns >= 5) & (len(rows) - ns >= 5)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
            b = int(gain.argmax())
            if gain[b] > best[0] and b < len(bounds[f]):
                best = (gain[b], f, b)
    if best[1] is None:
        step[rows] = g / (h + 1)
        return
    _, f, b = best
    low = x[rows, f] <= b
    for side, above in ((low, False), (~low, True)):
        _tree(x, bounds, gradient, hessian, rows[side], (*path, (int(f), above, float(bounds[f][b]))), depth - 1, features, out, step)


def _holds(values: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for f, above, bound in path:
        ok &= values[:, f] > bound if above else values[:, f] <= bound
    return ok


def fit_rules(values: np.ndarray, labels: np.ndarray, penalty: float = 0.0005, seed: int = 7) -> Rules:
    """Rules from paths of boosted trees, weighted by a lasso logistic regression (proximal gradient)."""
    y = labels.astype(float)
    if len(y) == 0 or y.min() == y.max():
        p = y.mean() if len(y) else 1.0
        return Rules(40.0 if p >= 1 else -40.0 if p <= 0 else float(np.log(p / (1 - p))), [])
    bounds = [np.unique(np.quantile(values[:, f], np.arange(1, BINS) / BINS)) for f in range(values.shape[1])]
    x = np.stack([np.searchsorted(b, values[:, f], "left") for f, b in enumerate(bounds)], 1)
    rng, margin, paths = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.sort(rng.permutation(len(y))[: max(50, len(y) // 2)])
        features = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        _tree(x, bounds, y - p, p * (1 - p) + 1e-6, rows, (), DEPTH, features, paths, step)
        margin += 0.3 * step
    paths = sorted(set(paths))
    r = np.stack([_holds(values, p) for p in paths], 1).astype(float)
    share = r.mean(0)
    keep = (share > 0.002) & (share < 0.998)
    paths, r = [p for p, k in zip(paths, keep) if k], r[:, keep]
    mean = r.mean(0)
    z = r - mean
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    seen, t = w.copy(), 1.0
    for _ in range(400):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(z @ seen + b, -40, 40)))
        b += 0.5 * float((y - p).mean())
        new = seen + rate * (z.T @ (y - p)) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * penalty)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        seen, w, t = new + (t - 1) / t2 * (new - w), new, t2
    on = np.flatnonzero(w)
    rules = [(tuple((STATISTICS[f], above, bound) for f, above, bound in paths[i]), float(w[i])) for i in on]
    return Rules(b - float(mean[on] @ w[on]), rules)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are not learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Rules for labels.quality from at most ``sample`` labelled rows of ``docs`` that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    got = with_statistics(rows).join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *[f"s_{n}" for n in STATISTICS]).limit(2 * sample).collect()
    values = np.array([[r[f"s_{n}"] for n in STATISTICS] for r in got]).reshape(-1, len(STATISTICS))
    return fit_rules(values, np.array([r["quality"] for r in got], int))


def scored(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    got = with_statistics(docs).withColumn("score", rules.column())
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in text], columns=list(STATISTICS), dtype="float64")


def accepted(docs: DataFrame, rules: Rules) -> DataFrame:
    """Rows of ``docs``, with all their columns, that the rules predict to be good."""
    got = F.pandas_udf(_statistics, ", ".join(f"{name} double" for name in STATISTICS))(docs["text"].cast("string"))
    return batches_bounded(docs).where(rules.column(lambda name: got[name]) >= THRESHOLD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, scored by rules learnt from ``labels``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, learn(docs, labels))
