"""Exact dedup over an extendible-hash index in shared files.

1. *Entries.* Each text is normalised (A-Z to lower case), digested, and listed
   as ``(doc_id, key, sha, n)``; ``key`` is the first 64 bits of the digest.
2. *Directory.* It starts with one bucket and doubles, splitting every overfull
   bucket by one more bit of the key, until each bucket holds at most
   ``bucket_bytes`` of distinct text. It is worked out from the bytes of at most
   ``2**SLOT_BITS`` key prefixes, so what reaches the driver and the tasks has a fixed
   bound; a slot of that depth that is still overfull parts by as many more bits
   as its bytes call for, without slots of their own (keys are digests, so its
   parts are near equal). A bucket is named by the bits of its keys.
3. *Owners.* Scan tasks collapse equal texts among what they read (a text that
   a third of all rows hold leaves each task once), then send the texts to the
   owner of their bucket. The owner chains texts with equal keys, compares
   their bytes, and writes the bucket's part of the index.
4. *Lookup.* Entries join the index on key and digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import fresh_names, settle, written

SLOT_BITS = 18
BUCKET_BYTES = 4 << 20
COLLAPSE_BYTES = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _entries(batches):
    for batch in batches:
        keys, shas, sizes = [], [], []
        for t in batch.column(1):
            b = normalised(t.as_py())
            d = hashlib.sha256(b).digest()
            keys.append(key_of(d))
            shas.append(d)
            sizes.append(len(b))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "key", "sha", "n"])


class Directory:
    """Depth of the bucket of every key prefix: ``depths[p]`` bits name the bucket of the ``depth``-bit prefix ``p``."""

    def __init__(self, histogram: dict[int, int], bucket_bytes: int, slot_bits: int = SLOT_BITS):
        finest = np.zeros(1 << slot_bits, dtype=np.float64)
        for prefix, size in histogram.items():
            finest[prefix] += size
        self.depth = 0
        depths, sizes = np.zeros(1, dtype=np.int64), finest.sum(keepdims=True)  # of each slot: its bucket's bits and bytes
        while self.depth < slot_bits and (sizes > bucket_bytes).any():
            # Double: every slot becomes two; an overfull bucket parts by the new bit.
            self.depth += 1
            depths, sizes = np.repeat(depths, 2), np.repeat(sizes, 2)
            full = sizes > bucket_bytes
            by_slot = finest.reshape(1 << self.depth, -1).sum(axis=1)
            depths[full], sizes[full] = self.depth, by_slot[full]
        over = np.maximum(sizes / bucket_bytes, 1)
        self.depths = np.minimum(depths + np.ceil(np.log2(over)).astype(np.int64), 62)

    def bucket(self, key: int) -> int:
        """A 1, then the bits of the key that name its bucket."""
        bits = key & 0xFFFFFFFFFFFFFFFF
        depth = int(self.depths[bits >> (64 - self.depth)]) if self.depth else int(self.depths[0])
        return 1 << depth | bits >> (64 - depth)


def _collapsed(directory: Directory):
    """Scan side: each distinct text of what a task has read, once."""

    def out(held):
        rows = [(directory.bucket(k), k, b, most, n) for k, chain in held.items() for b, most, n in chain]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["bucket", "key", "body", "most", "n"])

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = normalised(text.as_py())
                size += chain_in(held, key_of(hashlib.sha256(b).digest()), b, doc, 1)
                if size > COLLAPSE_BYTES:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    return run


def chain_in(held: dict[int, list], key: int, body: bytes, most: int | None, n: int) -> int:
    """Add a text to its key's chain, comparing bytes; the bytes newly held."""
    chain = held.setdefault(key, [])
    for link in chain:
        if link[0] == body:
            link[1] = link[1] if most is None else most if link[1] is None else max(link[1], most)
            link[2] += n
            return 0
    chain.append([body, most, n])
    return len(body) + 100


def _owner(bucket_rows: pa.Table) -> pa.Table:
    """Owner of a bucket: chains of distinct texts by key, and of each the row that stays."""
    held: dict[int, list] = {}
    for key, body, most, n in zip(*(bucket_rows.column(c) for c in ("key", "body", "most", "n")), strict=True):
        chain_in(held, key.as_py(), body.as_py(), most.as_py(), n.as_py())
    bucket = bucket_rows.column("bucket")[0].as_py()
    rows = [(bucket, k, at, hashlib.sha256(b).digest(), most, n) for k, chain in held.items() for at, (b, most, n) in enumerate(chain)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "key", "chain", "sha", "keep_id", "group_size"])


def build_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, Directory]:
    """``(entries, index, directory)`` of ``docs(doc_id, text)``; the first two are shared files."""
    settle(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries = written(docs.mapInArrow(_entries, "doc_id long, key long, sha binary, n long"), "entries")
    prefix = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    distinct = entries.groupBy("key").agg(F.max("n").alias("n"))
    sizes = distinct.groupBy(prefix.cast("int").alias("p")).agg(F.sum(F.col("n") + 100).alias("n")).toPandas()
    directory = Directory(dict(zip(sizes["p"].tolist(), sizes["n"].tolist(), strict=True)), bucket_bytes)
    texts = docs.mapInArrow(_collapsed(directory), "bucket long, key long, body binary, most long, n long")
    index = texts.groupBy("bucket").applyInArrow(_owner, "bucket long, key long, chain int, sha binary, keep_id long, group_size long")
    return entries, written(index, "index"), directory


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays. Null text counts as
    empty; a null ``doc_id`` is below all others. Rows that repeat a ``doc_id``
    count each in ``group_size`` and are marked alike. An empty table gives an
    empty result; other columns are not read.
    """
    entries, index, _ = build_index(docs, bucket_bytes)
    found = entries.join(index, ["key", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that :func:`exact_dedup` drops; of rows alike in id and text, one stays."""
    name, sha, own = fresh_names(docs, 3)
    marks = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(sha)).distinct()
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.withColumn(own, F.sha2(F.translate(body, _UPPER, _UPPER.lower()), 256))
    kept = kept.join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(own) == F.col(sha)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as n from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(n) as text_sha256
from t window w as (partition by n)
"""
