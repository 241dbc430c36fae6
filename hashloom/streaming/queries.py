"""Queries over the driver's tables, run as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import digests
from hashloom.sources import tables
from hashloom.streaming import twins


def _events(spark, d):
    return twins.source(spark, d, "events", tables.read(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_waiter_match(spark, d):
    e = _events(spark, d)
    reports = e.where("event_id % 3 = 0").select(F.col("event_id").alias("report_event_id"), F.col("ts").alias("report_ts"), "value")
    jobs = e.where("event_type <> 'view'").select("event_id", "user_id", "ts")
    return twins.drained(twins.matched(jobs, reports, "event_id", "ts").select("event_id", "user_id", "value", F.col("report_event_id").alias("reported")))


def stream_memoize(spark, d):
    e = _events(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), (F.col("event_id") % 5 == 0).alias("skip"))
    return twins.replay(e)


def stream_dedup_content(spark, d):
    docs = twins.source(spark, d, "documents", tables.read(spark, d, "documents").schema)
    return twins.drained(twins.first_of(docs.select(digests.hash_of(F.col("text")).alias("hash"), digests.size_of(F.col("text")).alias("size_bytes")), "hash", "size_bytes"))


def stream_execute(spark, d):
    """Each event submits its type for its user; odd users' types are cached, every seventh report is an error and every eleventh has no result."""
    e = _events(spark, d).select(F.col("event_id").cast("string").alias("job_id"), F.concat_ws("|", "user_id", "event_type").alias("action"))
    log = tables.read(spark, d, "events")
    i = F.col("event_id")
    code = F.when(F.col("event_type") == "error", 1).otherwise(0)
    cache = log.where("user_id % 2 = 1 and event_type <> 'error'").select(F.concat_ws("|", "user_id", "event_type").alias("action"), F.lit(0).alias("exit_code")).distinct()
    reports = log.where("event_id % 3 <> 0").select(i.cast("string").alias("job_id"), F.when(i % 7 == 0, "lost").otherwise("").alias("error_message"), F.when(i % 11 != 0, F.struct(code.alias("exit_code"))).alias("result"))
    made = twins.drained(twins.operations(e, cache, reports))
    return made.select("name", "done", "response.exit_code", "response.cached_result", "error.code", "error.message")


QUERIES = {f.__name__: f for f in (stream_execute, stream_waiter_match, stream_memoize, stream_dedup_content)}
