"""Blobs in chunks, and back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions import digests
from hashloom.sources.shared import settle

CHUNKS = "blob string, idx int, start long, data binary"
#: Bits of the cut masks of the published FastCDC code, by the number of bits set. Fixed values.
MASKS = {
    5: 0x0000000001804110, 6: 0x0000000001803110, 7: 0x0000000018035100, 8: 0x0000001800035300, 9: 0x0000019000353000, 10: 0x0000590003530000,
    11: 0x0000D90003530000, 12: 0x0000D90103530000, 13: 0x0000D90303530000, 14: 0x0000D90313530000, 15: 0x0000D90F03530000, 16: 0x0000D90303537000,
    17: 0x0000D90703537000, 18: 0x0000D90707537000, 19: 0x0000D91707537000, 20: 0x0000D91747537000, 21: 0x0000D91767537000, 22: 0x0000D93767537000,
}
GEAR = [int.from_bytes(hashlib.md5(bytes([i])).digest()[:8], "big") for i in range(256)]
_ALL = (1 << 64) - 1


def split_fixed(blobs: DataFrame, size: int) -> DataFrame:
    """``blob, idx, start, data``: chunks of ``size`` bytes, the last one shorter; an empty blob is one empty chunk."""
    n = F.octet_length("data")
    at = F.explode(F.sequence(F.lit(0), F.greatest((n - 1).cast("int"), F.lit(0)), F.lit(size))).alias("start")
    parts = blobs.select(F.col("hash").alias("blob"), "data", at)
    return parts.select("blob", (F.col("start") / size).cast("int").alias("idx"), F.col("start").cast("long").alias("start"), F.expr(f"substring(data, start + 1, {size})").alias("data"))


_SLICE = 1 << 20


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: of the last 64 bytes, as older ones are shifted out. Windows are doubled six times."""
    h = gear[data]
    for width in (1, 2, 4, 8, 16, 32):
        if width < len(h):
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
    return h


def _marks(body: bytes, gear: np.ndarray, masks: list[int]) -> list[np.ndarray]:
    """For each mask the places whose hash of the last 64 bytes has none of its bits."""
    data, out = np.frombuffer(body, dtype=np.uint8), [[] for _ in masks]
    for low in range(0, len(data), _SLICE):
        lead = min(low, 64)
        h = gear_hashes(data[low - lead : low + _SLICE], gear)[lead:]
        for mask, found in zip(masks, out, strict=True):
            found.append(np.flatnonzero(h & np.uint64(mask) == 0) + low)
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]


def gear_cuts(body: bytes, average: int, seed: int = 0) -> list[int]:
    """Ends of the chunks by FastCDC with normalisation 2: least a quarter, most four times the average.

    Hashing starts anew at each chunk's least size, so its first 63 places are hashed one by one; from
    there on the hash is that of the last 64 bytes, wherever the chunk began. Bytes are taken in pairs: of
    an odd number that is left the last one is no place for a cut. ``seed`` alters the gear table.
    """
    least, most, bits = average // 4, average * 4, average.bit_length() - 1
    masks = [MASKS[bits + 2], MASKS[bits - 2]]
    table = [g ^ seed for g in GEAR]
    marks = _marks(body, np.array(table, dtype=np.uint64), masks)
    ends, start, n = [], 0, len(body)
    while n - start > least:
        stop, centre = min(n, start + most), min(n, start + average)
        last = start + (stop - start) // 2 * 2
        begin = start + least // 2 * 2
        h, cut = 0, None
        for i in range(begin, min(begin + 63, last)):
            h = ((h << 1) + table[body[i]]) & _ALL
            if not h & masks[i - start >= (centre - start) // 2 * 2]:
                cut = i
                break
        turn = start + (centre - start) // 2 * 2
        for which, low, high in ((0, begin + 63, min(turn, last)), (1, max(begin + 63, turn), last)):
            if cut is None and low < high:
                at = np.searchsorted(marks[which], low)
                if at < len(marks[which]) and marks[which][at] < high:
                    cut = int(marks[which][at])
        ends.append(stop if cut is None else cut)
        start = ends[-1]
    if start < n or not n:
        ends.append(n)
    return ends


def longest_cuts(body: bytes, least: int, horizon: int) -> list[int]:
    """Ends of chunks of at least ``least`` and under twice as many bytes: cut where the gear hash is greatest within the horizon, and again until the chunks are short enough."""
    n = len(body)
    if n < 2 * least:
        return [n]
    data, gear = np.frombuffer(body, dtype=np.uint8), np.array(GEAR, dtype=np.uint64)
    base, hashes = 0, np.zeros(0, dtype=np.uint64)  # of the places from base on: the horizons' starts never go back
    ends, work = [], [(0, n)]
    while work:
        start, stop = work.pop()
        if stop - start < 2 * least:
            ends.append(stop)
            continue
        low, high = start + least, min(start + least + horizon, stop - least)
        if high > base + len(hashes):
            base = low - 1
            lead = min(base, 64)
            hashes = gear_hashes(data[base - lead : max(base + _SLICE, high)], gear)[lead:]
        cut = low + int(hashes[low - 1 - base : high - base].argmax())  # the first of equals
        work += [(cut, stop), (start, cut)]
    return ends


def _split(cuts, *arguments):
    """Chunks of one blob after the other are its bytes: they share the buffer that came in, and a batch of at most some ``_SLICE`` bytes goes out at a time."""

    def chunks(blobs: pa.Array, bodies: pa.Array) -> pa.RecordBatch:
        ends, of, start, at = [0], [], [], 0
        for i, body in enumerate(bodies):
            own = cuts(body.as_py() or b"", *arguments)
            start += [0, *own[:-1]]
            of += [i] * len(own)
            ends += [at + e for e in own]
            at += own[-1]
        of = np.array(of, dtype=np.int64)
        idx = np.arange(len(of)) - np.searchsorted(of, of)
        first = np.frombuffer(bodies.buffers()[1], dtype=np.int32, count=1, offset=4 * bodies.offset)[0]
        data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.array(ends, dtype=np.int32)), bodies.buffers()[2].slice(int(first), at) if at else pa.py_buffer(b"")])
        return pa.RecordBatch.from_arrays([blobs.take(pa.array(of)), pa.array(idx, pa.int32()), pa.array(start, pa.int64()), data], ["blob", "idx", "start", "data"])

    def run(batches):
        for batch in batches:
            blobs, bodies = batch.column(0).cast(pa.string()), batch.column(1).cast(pa.binary())
            if bodies.null_count:
                bodies = bodies.fill_null(b"")
            upto = np.cumsum(pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(bodies):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _SLICE, side="right")))
                yield chunks(blobs.slice(low, high - low), bodies.slice(low, high - low))
                low = high

    return run


def split_gear(blobs: DataFrame, average: int = 1024, seed: int = 0) -> DataFrame:
    """Content-defined chunks by FastCDC; ``average`` is a power of two from 1 KiB to 1 MiB."""
    if average & (average - 1) or not 1 << 10 <= average <= 1 << 20:
        raise ValueError("the average must be a power of two from 1 KiB to 1 MiB")
    settle(blobs.sparkSession)
    return blobs.select("hash", "data").mapInArrow(_split(gear_cuts, average, seed), CHUNKS)


def split_longest(blobs: DataFrame, least: int = 256, horizon: int | None = None) -> DataFrame:
    """Content-defined chunks at repeated maxima of the gear hash; ``least`` is 64 or more."""
    if least < 64:
        raise ValueError("the least chunk size is 64")
    settle(blobs.sparkSession)
    return blobs.select("hash", "data").mapInArrow(_split(longest_cuts, least, 8 * least if horizon is None else horizon), CHUNKS)


def splice(chunks: DataFrame, *more: Column) -> DataFrame:
    """``blob, hash, size_bytes, ok``: the chunks of each blob joined in order, digested, and held against the blob's name.

    ``more``: columns from ``chunks``, an array of ``(idx, data)`` in order.
    """
    whole = chunks.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("idx", "data"))).alias("chunks"))
    body = F.array_join(F.transform("chunks", lambda c: c["data"].cast("string")), "").cast("binary")  # joined at once: each byte is copied a fixed number of times, and none looked at
    d = digests.digest_of(F.col("data"))
    return whole.select("blob", body.alias("data"), *more).select("blob", d["hash"].alias("hash"), d["size_bytes"].alias("size_bytes"), (d["hash"] == F.col("blob")).alias("ok"), *whole.select(*more).columns)


def ranged(blobs: DataFrame, offset: int, length: int | None = None) -> DataFrame:
    """``hash, data``: a part of each blob; beyond its end, nothing."""
    part = f"substring(data, {offset + 1}, {length})" if length is not None else f"substring(data, {offset + 1})"
    return blobs.select("hash", F.expr(part).alias("data"))
