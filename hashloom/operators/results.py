"""A cache of results by action: upsert, probe, and the replay of a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(updates: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The last value of each key in order of ``order``, null or not. Partial maxima are made before the shuffle."""
    last = F.max_by(F.struct(*value), F.struct(*order)).alias("v")
    return updates.groupBy(key).agg(last).select(key, *[F.col(f"v.{c}") for c in value])


def merged(cache: DataFrame, updates: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """``cache`` with the updates laid over it."""
    fresh = upsert(updates, key, order, value)
    return cache.join(fresh.select(key), key, "left_anti").select(key, *value).unionAll(fresh)


def probe(requests: DataFrame, cache: DataFrame, key: str, bypass: Column | None = None) -> DataFrame:
    """Every request with what the cache has for it and ``cache_hit``; a bypassed request misses."""
    held = cache.withColumn("__held", F.lit(True))
    skip = F.lit(False) if bypass is None else bypass
    return requests.withColumn("__skip", skip).join(held, key, "left").withColumn("cache_hit", F.coalesce(F.col("__held"), F.lit(False)) & ~F.col("__skip")).drop("__held", "__skip")


def running_max(rows: DataFrame, key: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the maximum of ``value`` over the rows of the key before this one.

    ``part`` must not fall as ``order`` rises. A window over each part of a key, and one over
    the parts' maxima, so that a key with very many rows is spread over its parts.
    """
    within = Window.partitionBy(*key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*key, part).agg(F.max(value).alias("__m")).select(*key, part, F.max("__m").over(before).alias("__carried"))
    return rows.withColumn("__own", F.max(value).over(within)).join(carried, [*key, part]).withColumn(out, F.greatest("__own", "__carried")).drop("__own", "__carried")


def replay(log: DataFrame, key: str, seq: str, part: str, ok: str = "exit_code", bypass: str = "skip", never: Column | None = None) -> DataFrame:
    """What a sequential client sees of each request of an ordered log.

    A request hits if it isn't bypassed and one before it, of the same key, succeeded; a bypassed
    success replaces what is stored; failures are never stored, and neither are the rows for
    which ``never`` holds. Adds ``hit``, ``source_seq`` (of the result it gets) and
    ``replayed_exit``.
    """
    stores = (F.col(ok) == 0) & ~(F.lit(False) if never is None else never)
    first = log.where(stores).groupBy(key).agg(F.min(seq).alias("__first"))
    seen = log.join(first, key, "left").withColumn("hit", ~F.col(bypass) & F.coalesce(F.col("__first") < F.col(seq), F.lit(False)))
    seen = seen.withColumn("__stored", F.when(~F.col("hit") & stores, F.col(seq))).drop("__first")
    seen = running_max(seen, [key], part, [seq], "__stored", "__last")
    return seen.withColumn("source_seq", F.when(F.col("hit"), F.col("__last")).otherwise(F.col(seq))).withColumn("replayed_exit", F.when(F.col("hit"), F.lit(0)).otherwise(F.col(ok)).cast("int")).drop("__stored", "__last")


def complete_hits(results: DataFrame, outputs: Column, store: DataFrame, key: str) -> DataFrame:
    """The cached results of which the store has every output (``outputs``: an array of digests)."""
    wanted = results.select(key, F.explode(outputs).alias("d")).select(key, F.col("d.hash").alias("hash"), F.col("d.size_bytes").alias("size_bytes"))
    broken = wanted.join(store.select("hash", "size_bytes"), ["hash", "size_bytes"], "left_anti").select(key).distinct()
    return results.join(broken, key, "left_anti")


def admissible(updates: DataFrame, store: DataFrame, *digests_of: str) -> DataFrame:
    """The updates of which the store has the named digests (struct columns)."""
    held = store.select(F.struct("hash", "size_bytes").alias("__h")).distinct()
    for name in digests_of:
        updates = updates.join(held, updates[name] == held["__h"], "left_semi")
    return updates
