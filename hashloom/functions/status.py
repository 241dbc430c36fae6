"""Status codes, and how a process ended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, INVALID_ARGUMENT, NOT_FOUND, RESOURCE_EXHAUSTED, FAILED_PRECONDITION, INTERNAL = 0, 3, 5, 8, 9, 13


def code_of(problem: Column) -> Column:
    """0, or 3 for a fault of the request, 5 for something absent, 13 for all else."""
    return F.when(problem.isNull() | (problem == "ok"), OK).when(problem == "NotFound", NOT_FOUND).when(problem.isin("InvalidLength", "InvalidHex", "NegativeSize", "SizeMismatch", "HashMismatch", "Empty", "TooLong", "MissingSeparator", "InvalidSize"), INVALID_ARGUMENT).otherwise(INTERNAL)


def sandbox_exit(timed_out: Column, out_of_memory: Column, code: Column, signal: Column) -> Column:
    """``struct(kind, code, signal)``: timeout before out-of-memory before an exit code before a signal; no news is signal -1."""
    kind = F.when(timed_out, "Timeout").when(out_of_memory, "OutOfMemory").when(code.isNotNull(), "Exited").otherwise("Signaled")
    return F.struct(kind.alias("kind"), F.when(kind == "Exited", code.cast("int")).alias("code"), F.when(kind == "Signaled", F.coalesce(signal, F.lit(-1)).cast("int")).alias("signal"))


def worker_exit(code: Column) -> Column:
    return F.coalesce(code, F.lit(-1)).cast("int")


def mirrored_exit(code: Column, signal: Column) -> Column:
    """What a parent that mirrors its child exits with: the code, 128 and the signal, or 127."""
    return F.coalesce(code, F.lit(128) + signal, F.lit(127)).cast("int")


def any_of(type_url: str, value: Column) -> Column:
    return F.struct(F.lit(type_url).alias("type_url"), value.cast("binary").alias("value"))


def phases(begun: Column, started: Column, ended: Column, cleared: Column) -> Column:
    """Microseconds of set-up, execution and tear-down."""
    us = lambda a, b: F.unix_micros(b) - F.unix_micros(a)
    return F.struct(us(begun, started).alias("setup_us"), us(started, ended).alias("execution_us"), us(ended, cleared).alias("teardown_us"))


def over_limit(elapsed_us: Column, limit_secs: Column) -> Column:
    """True where a wall-clock limit is set and passed."""
    return F.coalesce(elapsed_us > limit_secs * 1_000_000, F.lit(False))
