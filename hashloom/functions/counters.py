"""Resource counters out of the text of control-group files, without exploding lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hashloom.schemas import U64_MAX

_WIDE = "decimal(38,0)"


def u64(text: Column) -> Column:
    """An unsigned 64-bit number, or null: digits, perhaps after a plus sign, and not too many."""
    n = F.when(text.rlike(r"\A[+]?[0-9]{1,30}\z"), text.try_cast(_WIDE))
    return F.when(n <= F.lit(str(U64_MAX)).cast(_WIDE), n)


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def _keyed(text: Column, key: str) -> Column:
    """The second words of the lines that begin with ``key``."""
    return F.transform(F.filter(lines(text), lambda line: F.get(words(line), F.lit(0)) == key), lambda line: u64(F.get(words(line), F.lit(1))))


def last_of(text: Column, key: str) -> Column:
    """The last readable number of ``key``, or 0."""
    good = F.filter(_keyed(text, key), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(0).cast(_WIDE)).cast("decimal(20,0)")


def first_is_positive(text: Column, key: str) -> Column:
    """True if the first line of ``key`` has a number above 0; false without one."""
    return F.coalesce(F.get(_keyed(text, key), F.lit(0)) > 0, F.lit(False))


def gauge(text: Column) -> Column:
    return F.coalesce(u64(F.trim(F.regexp_replace(text, r"\A\s+|\s+\z", ""))), F.lit(0).cast(_WIDE)).cast("decimal(20,0)")


def summed(text: Column, prefix: str) -> Column:
    """Sum over all lines of the tokens after the first that begin with ``prefix``; unreadable ones are skipped, the sum saturates."""
    tokens = F.flatten(F.transform(lines(text), lambda line: F.slice(words(line), 2, 1_000_000)))
    values = F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit(prefix))), lambda t: u64(F.substring(t, len(prefix) + 1, 40)))
    top = F.lit(str(U64_MAX)).cast(_WIDE)
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0).cast(_WIDE), lambda s, v: F.least(s + v, top).cast(_WIDE)).cast("decimal(20,0)")


def accounting(cpu_stat: Column, memory_peak: Column, pids_peak: Column, io_stat: Column) -> Column:
    """The record of a run's counters; a missing file (null) counts 0."""
    zero = F.lit(0).cast("decimal(20,0)")
    part = lambda c, name: F.coalesce(c, zero).alias(name)
    return F.struct(
        part(last_of(cpu_stat, "user_usec"), "cpu_user_us"), part(last_of(cpu_stat, "system_usec"), "cpu_system_us"), part(gauge(memory_peak), "memory_peak_bytes"),
        part(summed(io_stat, "rbytes="), "io_read_bytes"), part(summed(io_stat, "wbytes="), "io_write_bytes"), part(gauge(pids_peak), "max_pids"),
    )


def out_of_memory(memory_events: Column) -> Column:
    return F.coalesce(first_is_positive(memory_events, "oom_kill"), F.lit(False))
