"""Between a submission and a worker: the queue, the workers' messages, and what a client is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions import status
from hashloom.operators.ordering import positions

#: Code of an operation that ended in an error of the engine or of a worker.
INTERNAL = 13


def dequeued(jobs: DataFrame, order: list[str], part: Column) -> DataFrame:
    """Jobs first in, first out: ``turn`` is the place in which each leaves the queue. An assignment without a job is skipped."""
    return positions(jobs.where(F.col("job_id").isNotNull()), order, part, "turn")


def reports_of(messages: DataFrame) -> DataFrame:
    """The results among a worker's messages ``payload(hello, result)``: a hello is ignored, so is a message of neither."""
    return messages.where(F.col("payload.result").isNotNull()).select("payload.result.*")


def problem_of(error_message: Column, result: Column) -> Column:
    """Null for a report with a result and no error; else why it is none."""
    error = F.coalesce(error_message, F.lit(""))
    return F.when(error != "", F.concat(F.lit("worker error: "), error)).when(result.isNull(), "worker reported no ActionResult")


def settled(waiters: DataFrame, reports: DataFrame) -> DataFrame:
    """Each waiter that got a report, with ``problem``: null, or why the report is no result.

    A report ``job_id, error_message, result`` without a waiter is dropped.
    """
    return waiters.join(reports, "job_id").withColumn("problem", problem_of(F.col("error_message"), F.col("result")))


def cacheable(seen: DataFrame) -> DataFrame:
    """Of the settled, those whose result is remembered: no problem, exit code 0."""
    return seen.where(F.col("problem").isNull() & (F.col("result.exit_code") == status.OK))


def operations(seen: DataFrame) -> DataFrame:
    """One finished operation for each submission: a response, or an error of code 13 with its message."""
    failed = F.col("problem").isNotNull()
    name = F.concat(F.lit("operations/"), F.col("job_id"))
    return seen.select(
        name.alias("name"), F.lit(True).alias("done"), F.when(~failed, F.struct(F.col("result.exit_code").alias("exit_code"), F.col("cache_hit").alias("cached_result"))).alias("response"),
        F.when(failed, F.struct(F.lit(INTERNAL).alias("code"), F.col("problem").alias("message"))).alias("error"),
    )
