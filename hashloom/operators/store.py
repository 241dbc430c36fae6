"""Operators on a store of blobs: what is missing, batch reads, verified batch writes.

A store is a table ``hash, size_bytes, data``; a request has ``pos`` besides, the
place of the row in its batch. Identity is the pair of hash and size; with
``key="hash"`` the hash alone decides, as in stores that are keyed so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions import digests, status

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _on(key: str) -> list[str]:
    return {"digest": ["hash", "size_bytes"], "hash": ["hash"]}[key]


def checked(requests: DataFrame) -> DataFrame:
    """The requests; a digest of a wrong shape fails the whole batch."""
    made = digests.required(F.col("hash"), F.col("size_bytes"))
    return requests.withColumn("__d", made).withColumn("hash", F.col("__d.hash")).withColumn("size_bytes", F.col("__d.size_bytes")).drop("__d")


def find_missing(requests: DataFrame, store: DataFrame, key: str = "digest", empty_is_present: bool = False) -> DataFrame:
    """The requests that the store lacks, repeats and all; ``pos`` keeps their order."""
    missing = requests.join(store.select(*_on(key)), _on(key), "left_anti").select(requests.columns)
    return missing.where(F.col("hash") != EMPTY) if empty_is_present else missing


def distinct_blobs(blobs: DataFrame, key: str = "digest") -> DataFrame:
    """One row of each digest."""
    return blobs.dropDuplicates(_on(key))


def batch_read(requests: DataFrame, store: DataFrame, key: str = "digest") -> DataFrame:
    """Every request with ``code`` 0 and ``data``, or 5 and a message. The store has one row a key."""
    held = store.select(*_on(key), "data", F.lit(True).alias("held"))
    read = requests.join(held, _on(key), "left")
    found = F.col("held").isNotNull()
    return read.select("pos", "hash", "size_bytes", F.when(found, status.OK).otherwise(status.NOT_FOUND).alias("code"), F.when(~found, "blob not found").alias("message"), "data")


def with_status(rows: DataFrame) -> DataFrame:
    """Rows ``pos, hash, size_bytes, data`` with the ``fault`` of each (``ok`` or the first that is found), its ``code`` and ``message``."""
    fault = digests.content_status(F.col("hash"), F.col("size_bytes"), F.col("data"))
    return rows.withColumn("fault", fault).withColumn("code", status.code_of(F.col("fault"))).withColumn("message", digests.message(F.col("fault"), F.col("hash"), F.col("size_bytes"), F.col("data")))


def batch_update(store: DataFrame, rows: DataFrame, key: str = "digest") -> tuple[DataFrame, DataFrame]:
    """``(status, store)``: a status for every row, and the store with the sound rows that it lacked.

    A row whose content isn't what its digest says is refused and not stored; the others are.
    """
    seen = with_status(rows)
    sound = distinct_blobs(seen.where(F.col("code") == status.OK).select("hash", "size_bytes", "data"), key)
    new = sound.join(store.select(*_on(key)), _on(key), "left_anti").select("hash", "size_bytes", "data")
    return seen.select("pos", "hash", "size_bytes", "code", "message"), store.select("hash", "size_bytes", "data").unionAll(new)


def to_upload(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """The candidates that the store lacks, one row a digest."""
    lacking = find_missing(candidates.select("hash", "size_bytes").distinct(), store)
    return distinct_blobs(candidates).join(lacking, ["hash", "size_bytes"], "left_semi")


def first_failure(statuses: DataFrame, *by: str) -> DataFrame:
    """Of each group the failed row of the lowest ``pos``; nothing for a group without one."""
    bad = statuses.where(F.col("code") != status.OK)
    return bad.groupBy(*by).agg(F.min_by(F.struct("pos", "code", "message"), "pos").alias("f")).select(*by, "f.pos", "f.code", "f.message")


def as_blobs(rows: DataFrame, content: Column, *keep: str) -> DataFrame:
    """A store's or a request's columns for the content of each row."""
    d = digests.digest_of(content)
    return rows.select(*keep, d["hash"].alias("hash"), d["size_bytes"].alias("size_bytes"), content.cast("binary").alias("data"))
