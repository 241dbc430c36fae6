"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Each document is encoded, ended by id 0, and cut: windows it fills alone stay
whole, and of the rest a part over half a window parts with that half. The
pieces below a window go, ``BATCH`` at a time and where they were read, into
``m`` windows by differencing: every piece starts as a partial partition of
``m`` sums; the two partitions of the largest spread merge, the largest sums of
one laid on the smallest of the other, until one is left. ``m`` starts at the
least that could hold the batch and rises by one for as long as a window is
over capacity. No id moves between tasks, so there is no shuffle.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import settle
from hashloom.llm.tokenizing import json_encoder, text_slices, tidy, vocabulary_path

WINDOW = 1024
BATCH = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, int]:
    """Window (0 to m-1) of each piece, and the largest window's sum."""
    if m == 1 or len(sizes) == 0:
        return np.zeros(len(sizes), dtype=np.int64), int(sizes.sum())
    # Leaves are 0..n-1, merges follow. A node's sums are ascending, less their least.
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(m, dtype=np.int64)
        sums[-1] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    n = len(sizes)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heap[0]
        joint = left + right[::-1]
        order = np.argsort(joint, kind="stable")
        joint = joint[order]
        joint -= joint[0]
        node = n + len(made)
        made.append((a, b, order))
        heapq.heapreplace(heap, (-int(joint[-1]), node, joint))
    # From the root down: which window each place of a node's sums is.
    window = {heap[0][1]: np.arange(m)}
    out = np.zeros(n, dtype=np.int64)
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[node - n]
        of = np.empty(m, dtype=np.int64)
        of[order] = window.pop(node)
        window[a], window[b] = of, of[::-1]
    for leaf, places in window.items():
        out[leaf] = places[-1]
    return out, int(np.bincount(out, weights=sizes, minlength=m).max())


def assign(sizes: list[int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Window of each piece and how many windows; none is over capacity."""
    held = np.asarray(sizes, dtype=np.int64)
    m = max(1, -(-int(held.sum()) // window))
    while True:
        at, most = difference(held, m)
        if most <= window:
            return at, m
        m += 1


def cuts(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole windows, then the rest in parts of half a window at most."""
    out = [(s, window) for s in range(0, n - n % window, window)]
    start, rest, half = n - n % window, n % window, max(1, window // 2)
    while rest:
        out.append((start, min(rest, half)))
        start, rest = start + min(rest, half), rest - min(rest, half)
    return out


def _pack(path: str, window: int, batch_size: int, end_id: int):
    kinds = [pa.int64()] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows_of(pieces, first):
        at, m = assign([p[2] for p in pieces], window)
        fill, rows = [0] * m, []
        for p, w in zip(pieces, at.tolist(), strict=True):
            rows.append((*p, first + w, fill[w]))
            fill[w] += p[2]
        return rows, first + m

    def record(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        from pyspark import TaskContext

        encoder = json_encoder(path)
        following = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in text_slices(texts):
                rows = []
                for doc, body in zip(ids[low:high], encoder.encode([t or "" for t in texts[low:high]]), strict=True):
                    body += end
                    n = len(body) // 4
                    for start, length in cuts(n, window):
                        piece = (doc, start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), n)
                        if length == window:
                            rows.append((*piece, following, 0))
                            following += 1
                        else:
                            waiting.append(piece)
                while len(waiting) >= batch_size:
                    more, following = rows_of(waiting[:batch_size], following)
                    rows += more
                    del waiting[:batch_size]
                if rows:
                    yield record(rows)
        if waiting:
            yield record(rows_of(waiting, following)[0])
        tidy()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, batch_size: int = BATCH, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are documents of the one end id. Rows that repeat a
    ``doc_id`` are packed each. A sequence's pieces stand gapless from offset 0 in
    order of their arrival. ``sequence_id`` is unique: the task's number above 40
    bits, a count below. An empty table gives no sequence; other columns are not
    read; a text of any length is cut, never dropped.
    """
    settle(docs.sparkSession)
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(path, window, batch_size, end_id), SCHEMA)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
