"""Host probes: what the text of a kernel file says, and reports over probes.

The probing itself is not the engine's; these read text that was gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, WARN, FAIL = "Pass", "Warn", "Fail"
LEAST_KERNEL = (5, 10)


def kernel_version(release: Column) -> Column:
    """``struct(major, minor)``, null unless the first two parts between dots and dashes are numbers."""
    parts = F.split(release, "[.-]")
    part = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"\A[+]?[0-9]+\z"), F.get(parts, F.lit(i)).try_cast("bigint"))
    major, minor = part(0), part(1)
    fits = (major < 1 << 32) & (minor < 1 << 32)
    return F.when(fits, F.struct(major.alias("major"), minor.alias("minor")))


def kernel_status(release: Column) -> Column:
    v = kernel_version(release)
    return F.when(v.isNotNull() & (v >= F.struct(F.lit(LEAST_KERNEL[0]).cast("bigint").alias("major"), F.lit(LEAST_KERNEL[1]).cast("bigint").alias("minor"))), PASS).otherwise(FAIL)


def namespaces_status(most: Column, gate: Column) -> Column:
    """From the text of the limit of user namespaces and of the distribution's gate (null: no such file)."""
    n = F.when(F.trim(most).rlike(r"\A[+]?[0-9]+\z"), F.trim(most).try_cast("decimal(20,0)"))
    return F.when(n.isNull() | (n == 0), FAIL).when(gate.isNull() | (F.trim(gate) == "1"), PASS).otherwise(FAIL)


def unified_hierarchy(mounts: Column) -> Column:
    """True if a line of the mount table mounts cgroup2 in its place."""
    words = lambda line: F.filter(F.split(line, r"[ \t]+"), lambda w: w != "")
    return F.exists(F.split(mounts, "\n"), lambda line: (F.get(words(line), F.lit(1)) == "/sys/fs/cgroup") & (F.get(words(line), F.lit(2)) == "cgroup2"))


def seccomp_listed(status: Column) -> Column:
    return F.exists(F.split(status, "\n"), lambda line: F.startswith(line, F.lit("Seccomp:")))


def present(flag: Column, absent: str = FAIL) -> Column:
    return F.when(flag, PASS).otherwise(absent)


def _rule(state: Column, detail: Column) -> Column:
    return F.struct(state.alias("status"), detail.alias("detail"))


def slice_rule(there: Column, error: Column, path: str, remedy: str) -> Column:
    """``struct(status, detail)``: a control-group slice must be there, and a folder could be made in it (``error``: null, or why not)."""
    detail = F.when(~there, f"{path} missing — run {remedy}").when(error.isNotNull(), F.concat(F.lit(f"cannot mkdir under {path}: "), error))
    return _rule(present(there & error.isNull()), detail)


def memory_peak_rule(there: Column, release: Column) -> Column:
    """Without the gauge a warning: peaks then come from the events of each action's own group."""
    detail = F.concat(F.lit("absent on kernel "), F.coalesce(release, F.lit("unknown")), F.lit("; falling back to memory.events on the per-action cgroup"))
    return _rule(present(there, WARN), F.when(~there, detail))


def setgroups_rule(there: Column) -> Column:
    return _rule(present(there), F.when(~there, "required for gid_map writes under unprivileged userns"))


def label(status: Column) -> Column:
    """Five characters wide."""
    return F.when(status == PASS, " OK  ").when(status == WARN, "WARN ").otherwise("FAIL ")


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def counts(probes: DataFrame, *by: str) -> DataFrame:
    """Failures, warnings and whether nothing failed (true of nothing)."""
    return probes.groupBy(*by).agg(F.count_if(F.col("status") == FAIL).alias("failures"), F.count_if(F.col("status") == WARN).alias("warnings"), F.coalesce(F.bool_and(F.col("status") != FAIL), F.lit(True)).alias("functional"))


def summary(failures: Column, warnings: Column) -> Column:
    count = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"), plural(n))
    return (
        F.when(failures > 0, F.concat(F.lit("Sandbox is NOT functional. "), count(failures, "failure"), F.lit(", "), count(warnings, "warning"), F.lit(".")))
        .when(warnings > 0, F.concat(F.lit("Sandbox is functional. "), count(warnings, "warning"), F.lit(".")))
        .otherwise("Sandbox is functional.")
    )


def lines(probes: DataFrame, *by: str) -> DataFrame:
    """A report's lines, in the order of the probes."""
    line = F.concat(F.lit("["), label(F.col("status")), F.lit("] "), F.col("name"), F.when(F.col("detail").isNotNull(), F.concat(F.lit(" — "), F.col("detail"))).otherwise(""))
    return probes.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))
