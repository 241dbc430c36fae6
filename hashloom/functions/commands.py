"""Command lines, environments, paths and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hashloom.schemas import SANDBOX_CONFIG, U64_MAX

NUL = "\0"
PERIOD_US = 100_000


def argv_status(argv: Column) -> Column:
    return F.when(argv.isNull() | (F.size(argv) == 0), "argv is empty").when(F.exists(argv, lambda a: F.contains(a, F.lit(NUL))), "argv entry contains NUL").otherwise("ok")


def env_status(env: Column) -> Column:
    """``env`` is an array of ``(_1, _2)``."""
    bad = F.exists(env, lambda e: F.contains(e["_1"], F.lit("=")) | F.contains(e["_1"], F.lit(NUL)) | F.contains(e["_2"], F.lit(NUL)))
    return F.when(bad, "env entry contains NUL or '='").otherwise("ok")


def env_lines(env: Column) -> Column:
    return F.transform(env, lambda e: F.concat(e["_1"], F.lit("="), e["_2"]))


def rebased(root: Column, path: Column) -> Column:
    """``path`` without its leading slashes under ``root``."""
    return F.concat(root, F.lit("/"), F.ltrim(path, F.lit("/")))


def rootfs_is_empty(rootfs: Column) -> Column:
    """No binds, temporary file systems or links (null counts as none)."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return rootfs.isNull() | (none(rootfs["ro_binds"]) & none(rootfs["tmpfs"]) & none(rootfs["symlinks"]))


def first_existing(candidates: Column, present: Column) -> Column:
    """The first of ``candidates`` that ``present`` holds, or null."""
    return F.get(F.filter(candidates, lambda c: F.array_contains(present, c)), F.lit(0))


def hostname(name: Column, fallback: str = "unknown") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def cpu_max(milli: Column) -> Column:
    """``<quota> <period>`` of so many thousandths of a CPU; the product saturates at 64 unsigned bits."""
    product = F.least(milli.cast("decimal(20,0)").cast("decimal(38,0)") * F.lit(PERIOD_US).cast("decimal(6,0)"), F.lit(str(U64_MAX)).cast("decimal(38,0)"))
    return F.concat(F.floor(product / F.lit(1000)).cast("decimal(20,0)").cast("string"), F.lit(f" {PERIOD_US}"))


def _pairs(of: Column) -> Column:
    """Arrays of two as ``(_1, _2)``; null as none."""
    none = F.array().cast("array<struct<_1:string,_2:string>>")
    return F.coalesce(F.transform(of, lambda p: F.struct(p[0].alias("_1"), p[1].alias("_2"))), none)


def _determinism(policy: Column) -> Column:
    """Names stay null where they aren't given; switches are off."""
    off = lambda name: F.coalesce(policy[name], F.lit(False)).alias(name)
    return F.struct(policy["hostname"].alias("hostname"), off("timezone_utc"), policy["source_date_epoch"].alias("source_date_epoch"), off("strip_ld_preload"), off("strip_path"))


def config_of(document: Column) -> Column:
    """A sandbox document with its defaults; what isn't JSON of this schema fails the query."""
    made = F.from_json(document, SANDBOX_CONFIG, {"mode": "FAILFAST"})
    root, no_names = made["rootfs"], F.array().cast("array<string>")
    return F.struct(
        made["argv"].alias("argv"), _pairs(made["env"]).alias("env"), made["workdir"].alias("workdir"),
        F.coalesce(made["stdin"], F.lit("null")).alias("stdin"), F.coalesce(made["network"], F.lit("none")).alias("network"), made["limits"].alias("limits"),
        F.struct(_pairs(root["ro_binds"]).alias("ro_binds"), _pairs(root["tmpfs"]).alias("tmpfs"), _pairs(root["symlinks"]).alias("symlinks"), root["input_root"].alias("input_root")).alias("rootfs"),
        _determinism(made["determinism"]).alias("determinism"), F.coalesce(made["retained_caps"], no_names).alias("retained_caps"), F.coalesce(made["extra_seccomp_allow"], no_names).alias("extra_seccomp_allow"),
    )


def version_banner(name: str, version: str, commit: str | None = None) -> Column:
    return F.lit(f"{name} {version}" + (f" ({commit})" if commit else ""))
