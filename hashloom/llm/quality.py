"""Document quality by Bradley-Terry pairwise ranking.

Of a good and a poor document the good one is preferred with probability
``sigmoid(s(good) - s(poor))``; ``s`` is linear in the features of a text. The
weights maximise the likelihood of preference pairs, which is a logistic loss
on feature differences. The threshold is the quantile of the fitted documents'
scores at the share of poor ones among them; the score is
``sigmoid((s - threshold) / spread)``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import drop, scratch, written_to
from hashloom.llm.labelled import among, fold_of, marked, moments, newton, ranked, sigmoid, summed, sums, tally

FOLDS, HELD_OUT = 3, 1
#: What all pairs together weigh against the ridge.
PAIRS = 60_000
BLOCK, RARE = 2048, 64
#: Byte classes, by code: lower, upper, digit, space, newline, sentence marks, other ASCII marks, beyond ASCII.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[128:] = 7
_DOUBLE = re.compile(r"[!#$%&*|=~^<>]")
NAMES = ("upper", "digit", "newline", "marks", "symbols", "wide", "uppers", "symbol_words", "repeats", "repeated", "distinct", "mean_word", "length", "long_words", "copied_lines", "worst_line_symbols", "worst_line_upper", "worst_line_repeats")


def features(text: str | None) -> list[float]:
    """Shares and logarithms of counts; all 0 for a text without words."""
    body = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(body)
    kinds = np.bincount(_CLASS[np.frombuffer(body, dtype=np.uint8)], minlength=8)
    letters = kinds[0] + kinds[1] + kinds[7]
    repeats = sum(map(str.__eq__, words, words[1:]))
    symbols = len(_DOUBLE.findall(text))
    uppers = sum(map(str.isupper, words))
    lines = [x for x in text.split("\n") if x]
    worst = [0.0, 0.0, 0.0]
    for line in set(lines):
        if len(line) < 8:
            continue
        m = line.count(" ") + 1
        own = line.split(" ")
        for i, v in enumerate((len(_DOUBLE.findall(line)) / m, sum(map(str.isupper, own)) / m, sum(map(str.__eq__, own, own[1:])) / m)):
            if v > worst[i]:
                worst[i] = v
    distinct = len(set(words))
    return [
        kinds[1] / max(1, letters), kinds[2] / size, kinds[4] / n, kinds[5] / n, kinds[6] / size, kinds[7] / size,
        float(np.log1p(uppers)), symbols / n, repeats / n, float(np.log1p(repeats)), distinct / n, size / n / 10, float(np.log1p(n)) / 5,
        sum(len(w) > 25 for w in words) / n, 1 - len(set(lines)) / max(1, len(lines)), *(min(v, 2.0) for v in worst),
    ]


class Ranking:
    def __init__(self, mean, scale, weights, threshold: float, spread: float):
        self.mean, self.scale, self.weights, self.threshold, self.spread = mean, scale, weights, threshold, spread

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(NAMES))
        return sigmoid((self.worth(x) - self.threshold) / self.spread)


def pair_parts(good: np.ndarray, poor: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and, row by row, curvature of the log-likelihood of all pairs of a good and a poor row."""
    k = len(w)
    slope, curve, worth = np.zeros(k), np.zeros((k, k)), poor @ w
    for low in range(0, len(good), 1024):
        some = good[low : low + 1024]
        lost = 1 - sigmoid((some @ w)[:, None] - worth)
        slope += lost.sum(axis=1) @ some - lost.sum(axis=0) @ poor
        weight = lost * (1 - lost)
        cross = some.T @ weight @ poor
        curve += (some * weight.sum(axis=1)[:, None]).T @ some + (poor * weight.sum(axis=0)[:, None]).T @ poor - cross - cross.T
    return np.concatenate([slope, curve.ravel()])


def weights_of(parts, pairs: float) -> np.ndarray:
    """Weights from the sum of all pairs' parts; together they weigh as ``PAIRS`` against the ridge."""
    k = len(NAMES)

    def step(w):
        got = parts(w) * (PAIRS / pairs)
        return got[:k], got[k:].reshape(k, k)

    return newton(step, k, 2.0, 50, False)


def _blank(mean, scale, good: int, poor: int) -> Ranking:
    """Nothing to compare: everything is as good as the one class."""
    return Ranking(mean, scale, np.zeros(len(NAMES)), -1.0 if good or not poor else 1.0, 1.0)


def fit_pairs(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Weights from every pair of a good and a poor document."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    ranking, z = _blank(mean, scale, (y == 1).sum(), (y == 0).sum()), np.clip((x - mean) / scale, -8, 8)
    good, poor = z[y == 1], z[y == 0]
    if len(good) and len(poor):
        ranking.weights = weights_of(lambda w: pair_parts(good, poor, w), len(good) * len(poor))
        worth = z @ ranking.weights
        ranking.threshold, ranking.spread = float(np.quantile(worth, len(poor) / len(y))), float(worth.std() / 3 + 1e-9)
    return ranking


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """A ranking from all labelled rows outside the held-out fold.

    The rows are dealt into blocks by a hash of the id, and every pair within a block counts: up to ``BLOCK``
    rows are one block, and a block has some ``BLOCK`` rows, or as many as hold ``RARE`` of the rarer class.
    """
    marks = marked(labels, label, FOLDS, HELD_OUT)
    n, positive = tally(marks)
    names = [f"x{i}" for i in range(len(NAMES))]

    def measure(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("y"), *map(pa.array, x.T.copy())], ["block", "y", *names])

    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "quality-fit"))
        return written_to(df, paths[-1])

    try:
        blocks = max(1, min(n // BLOCK, min(positive, n - positive) // RARE))
        own = among(docs, marks, n).select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "text", "y")
        rows = kept(own.mapInArrow(measure, "block long, y int, " + ", ".join(f"{x} double" for x in names)))
        count, good, mean, deviation = moments(rows, names)
        scale = deviation + 1e-6 if count else deviation
        ranking = _blank(mean, scale, good, count - good)
        if not good or good == count:
            return ranking
        one = F.array_sort(F.collect_list(F.struct("y", F.array(*names).alias("x"))))
        dealt = kept(rows.groupBy("block").agg(one.alias("r")).select(F.transform("r", lambda r: r["y"]).alias("y"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x")))

        def over(of):
            def run(batch):
                out = []
                for y, x in zip(batch.column("y"), batch.column("x"), strict=True):
                    y, z = y.values.to_numpy(), np.clip((x.values.to_numpy().reshape(-1, len(NAMES)) - mean) / scale, -8, 8)
                    out.append(of(z[y == 1], z[y == 0]))
                return np.array(out)

            return summed(dealt, run)

        pairs = over(lambda good, poor: np.array([float(len(good) * len(poor))]))[0]
        ranking.weights = w = weights_of(lambda w: over(lambda good, poor: pair_parts(good, poor, w)), pairs)
        worth = lambda x: np.clip((x - mean) / scale, -8, 8) @ w
        middle = sums(rows, names, lambda x, y: worth(x)[:, None])[0] / count
        ranking.spread = float(np.sqrt(sums(rows, names, lambda x, y: (worth(x)[:, None] - middle) ** 2)[0] / count) / 3 + 1e-9)

        def worths(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(worth(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)))], ["v"])

        values, at = kept(rows.mapInArrow(worths, "v double")), (count - 1) * ((count - good) / count)
        low, high = ranked(values, int(at)), ranked(values, min(int(at) + 1, count - 1))
        ranking.threshold = low + (high - low) * (at - int(at))
        return ranking
    finally:
        for path in paths:
            drop(spark, path)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null and empty texts have all features 0. Rows that repeat are scored each;
    an empty table gives no row; with one class of labels all texts go to it.
    """
    ranking = fit(docs, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
