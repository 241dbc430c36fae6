"""Labelled rows for fitting classifiers, and small fits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import settle


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds).cast("int")


def marked(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id, y`` of every labelled row outside the held-out fold.

    Rows with null id or label are left out; of rows that repeat an id the larger label counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of("doc_id", folds) != held_out))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))


def tally(marks: DataFrame) -> tuple[int, int]:
    """The number of labelled rows, and of those whose label is 1."""
    got = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    return got.n, got.y


_PAGE = 1 << 15


def among(docs: DataFrame, marks: DataFrame, n: int, where: Column | None = None) -> DataFrame:
    """``doc_id, text, y`` of the rows of ``docs`` that are among the ``n`` of ``marks`` (and meet ``where``, on ``doc_id``).

    A bit for each of the marked ids' hashes, one to two bytes a marked id, goes to all tasks; texts without
    one aren't shuffled. The join decides, by merging at every size: labels grow with the documents.
    """
    settle(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if where is not None:
        docs, marks = docs.where(where), marks.where(where)
    place = F.expr(f"pmod(xxhash64(doc_id), {max(_PAGE, 1 << (8 * n).bit_length())}L)")
    bits = marks.groupBy(F.floor(place / _PAGE).alias("page")).agg(F.bitmap_construct_agg(place % _PAGE).alias("bits"))
    here = docs.withColumn("page", F.floor(place / _PAGE)).withColumn("at", (place % _PAGE).cast("int"))
    byte = F.expr("cast(conv(hex(substring(bits, at div 8 + 1, 1)), 16, 10) as int)")
    found = here.join(F.broadcast(bits), "page").where(F.expr("1 << (at % 8)").bitwiseAND(byte) != 0)
    return found.select("doc_id", "text").join(marks.hint("merge"), "doc_id")


def newton(parts: Callable, size: int, ridge: float, rounds: int, intercept: bool) -> np.ndarray:
    """Weights by Newton steps; ``parts(w)`` is the likelihood's gradient and what curves it."""
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    if intercept:
        penalty[-1] = 1e-3
    for _ in range(rounds):
        slope, curve = parts(w)
        step = np.linalg.solve(curve + np.diag(penalty), slope - penalty * w)
        norm = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(norm, 1e-12))
        if norm < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, intercept: bool = True) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression by Newton steps."""
    full = np.hstack([x, np.ones((len(x), 1))]) if intercept else x

    def parts(w):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        return full.T @ (y - p), (full * (p * (1 - p))[:, None]).T @ full

    w = newton(parts, full.shape[1], ridge, rounds, intercept)
    return (w[:-1], float(w[-1])) if intercept else (w, 0.0)


def sums(rows: DataFrame, names: list[str], of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Columns of ``of(x, y)``, a row for each of ``rows``, summed as by :func:`summed`."""
    return summed(rows, lambda b: of(np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1), b.column("y").to_numpy(zero_copy_only=False).astype(float)))


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Columns of ``of(batch)``, summed in whole numbers: the order of rows doesn't matter. A task returns one row."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = of(batch) * 2.0**20
                high = np.rint(v)
                own = np.concatenate([high.astype(np.int64).sum(axis=0), np.rint((v - high) * 2.0**32).astype(np.int64).sum(axis=0)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["s"])

    got = [r.s for r in rows.mapInArrow(run, "s array<long>").collect()]
    whole = [sum(x) for x in zip(*got, strict=True)]
    half = len(whole) // 2
    return np.array([(h * 2**32 + low) / 2**52 for h, low in zip(whole[:half], whole[half:], strict=True)])


def moments(rows: DataFrame, names: list[str]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The number of rows and of those whose ``y`` is 1, and mean and deviation of the columns ``names``."""
    k = len(names)
    first = sums(rows, names, lambda x, y: np.hstack([x, y[:, None], np.ones((len(x), 1))]))
    if not len(first):
        return 0, 0, np.zeros(k), np.ones(k)
    mean = first[:k] / first[-1]
    return int(first[-1]), int(first[-2]), mean, np.sqrt(sums(rows, names, lambda x, y: (x - mean) ** 2) / first[-1])


def ranked(values: DataFrame, rank: int, most: int = 20_000) -> float:
    """The value of rank ``rank``, from 0, of the column ``v``: bins are counted until the one that holds it is small or of one value."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    inside = F.lit(True)
    while low < high:
        bin_of = F.least(F.floor((F.col("v") - low) / ((high - low) / 4096)), F.lit(4095))
        bins = values.where(inside).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        for b in bins:
            if rank < b.n:
                break
            rank -= b.n
        low, high, inside = b.low, b.high, F.col("v").between(b.low, b.high)
        if low < high and b.n <= most:
            return sorted(r.v for r in values.where(inside).collect())[rank]
    return low


@dataclass
class Fitted:
    n: int
    positive: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def logistic_over(rows: DataFrame, names: list[str], ridge: float = 1.0, rounds: int = 50) -> Fitted:
    """The ridge logistic regression of ``y`` on the columns ``names``, brought to mean 0 and deviation 1. Tasks send sums; no row leaves them."""
    k = len(names)
    n, positive, mean, deviation = moments(rows, names)
    scale = deviation + 1e-9
    if not n:
        return Fitted(0, 0, mean, scale, np.zeros(k), 0.0)
    upper = np.triu_indices(k + 1)

    def parts(w):
        def of(x, y):
            z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            p = 1 / (1 + np.exp(-np.clip((z * w).sum(axis=1), -30, 30)))
            return np.hstack([z * (y - p)[:, None], (z * (p * (1 - p))[:, None])[:, upper[0]] * z[:, upper[1]]])

        got = sums(rows, names, of)
        curve = np.zeros((k + 1, k + 1))
        curve[upper] = got[k + 1 :]
        return got[: k + 1], curve + np.triu(curve, 1).T

    w = newton(parts, k + 1, ridge, rounds, True)
    return Fitted(n, positive, mean, scale, w[:-1], float(w[-1]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
