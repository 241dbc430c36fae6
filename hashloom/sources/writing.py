"""Sinks: blobs appended, caches replaced as a whole, so that a reader sees a batch or none of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from hashloom.operators import results, store
from hashloom.sources import tables


def replace(df: DataFrame, path: str) -> None:
    """Lay ``df``, which may read from ``path``, in the place of the table there.

    The rows go to a version folder of their own; then a pointer to it takes the old pointer's place in one
    rename. A failure before that leaves the old version, and a reader sees one or the other.
    """
    spark = df.sparkSession
    version = f"version={uuid.uuid4().hex}"
    before = tables.version_of(spark, path)
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{tables.POINTER}.{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{tables.POINTER}")
    files = pointer.getFileSystem(conf)
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(fresh, pointer, over)
    if before:  # versions before the last stay for readers that have begun
        for old in files.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
            name = old.getPath().getName()
            if name.startswith("version=") and name not in (version, before):
                files.delete(old.getPath(), True)


def append_blobs(rows: DataFrame, path: str, key: str = "digest") -> DataFrame:
    """Store the sound rows that the store at ``path`` lacks; a status for every row.

    Only new blobs are written: they are appended in one job, so a failed batch leaves nothing.
    """
    spark = rows.sparkSession
    held = tables.open_store(spark, path)
    seen = store.with_status(rows)
    sound = store.distinct_blobs(seen.where("code = 0").select("hash", "size_bytes", "data"), key)
    sound.join(held.select("hash", *(["size_bytes"] if key == "digest" else [])), ["hash", "size_bytes"] if key == "digest" else ["hash"], "left_anti").select("hash", "size_bytes", "data").write.mode("append").parquet(path)
    return seen.select("pos", "hash", "size_bytes", "code", "message")


def upsert_results(updates: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Lay ``updates(action_hash, result, ...)`` over the cache at ``path``, the last in ``order`` winning; failures too are cached through this door."""
    spark = updates.sparkSession
    cache = tables.open_cache(spark, path)
    replace(results.merged(cache, updates, "action_hash", order, ["result"]), path)
    return tables.open_cache(spark, path)
