"""Shared folders, small tables and components for the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.sources.shared import settle, shared_dir  # noqa: F401

_live: dict[str, object] = {}
_kept: dict[str, object] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new path in the shared folder; it lives until :func:`release`, or the interpreter's end with ``keep``."""
    path = f"{shared_dir(spark)}/hashloom-{tag}-{uuid.uuid4().hex}"
    (_kept if keep else _live)[path] = spark
    return path


def scratched() -> set[str]:
    """The scratch paths that live."""
    return set(_live)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _live.pop(path, None)
    _kept.pop(path, None)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables. Only for callers that have written out what was made from them."""
    for path in list(_live):
        drop(spark, path)


@atexit.register
def _at_exit() -> None:
    for path, spark in [*_live.items(), *_kept.items()]:
        try:
            drop(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            return


def written_to(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # this write's shuffle files go when it has ended, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return written_to(df, scratch(df.sparkSession, tag, keep))


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    held, made, k = {c.lower() for c in df.columns}, [], 0
    while len(made) < n:
        if f"__{k}" not in held:
            made.append(f"__{k}")
        k += 1
    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished jobs now rather than at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``links`` has two long columns. Returns ``(node, component)`` for every node
    that has a link; ``component`` is the smallest node reachable. Each round is
    two aggregations with map-side combine and two equi-joins whose right side
    has one row a key, so a hub's links are split by the skew join. Nothing but
    a count and a checksum reaches the driver.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        edges = after
        if seen == (mark.n, mark.s):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
        seen = (mark.n, mark.s)
    raise RuntimeError("components did not settle")
