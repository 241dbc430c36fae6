"""Explicit schemas of the tables that the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: An unsigned 64-bit number; BIGINT would overflow above 2**63 - 1.
U64 = T.DecimalType(20, 0)
U64_MAX = (1 << 64) - 1

DIGEST = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("size_bytes", T.LongType(), False)])
BLOB = T.StructType([*DIGEST.fields, T.StructField("data", T.BinaryType())])
REQUEST = T.StructType([T.StructField("pos", T.LongType(), False), *DIGEST.fields])
UPDATE = T.StructType([*REQUEST.fields, T.StructField("data", T.BinaryType())])
STATUS = T.StructType([*REQUEST.fields, T.StructField("code", T.IntegerType(), False), T.StructField("message", T.StringType())])
NAME_VALUE = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
PLATFORM = T.ArrayType(NAME_VALUE)
COMMAND = T.StructType([
    T.StructField("arguments", T.ArrayType(T.StringType())), T.StructField("environment", T.ArrayType(NAME_VALUE)),
    T.StructField("output_paths", T.ArrayType(T.StringType())), T.StructField("working_directory", T.StringType()), T.StructField("platform", PLATFORM),
])
ACTION = T.StructType([
    T.StructField("command_digest", DIGEST), T.StructField("input_root_digest", DIGEST), T.StructField("timeout_us", T.LongType()),
    T.StructField("do_not_cache", T.BooleanType()), T.StructField("salt", T.BinaryType()), T.StructField("platform", PLATFORM),
])
METADATA = T.StructType([
    T.StructField("worker", T.StringType()),
    *(T.StructField(f"{what}_timestamp", T.TimestampType()) for what in ("queued", "worker_start", "worker_completed", "input_fetch_start", "input_fetch_completed", "execution_start", "execution_completed", "output_upload_start", "output_upload_completed")),
])
ACTION_RESULT = T.StructType([
    T.StructField("exit_code", T.IntegerType()), T.StructField("stdout_raw", T.BinaryType()), T.StructField("stderr_raw", T.BinaryType()),
    T.StructField("stdout_digest", DIGEST), T.StructField("stderr_digest", DIGEST), T.StructField("execution_metadata", METADATA),
])
CACHED = T.StructType([T.StructField("action_hash", T.StringType(), False), T.StructField("result", ACTION_RESULT)])
EDGE = T.StructType([T.StructField("parent_hash", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("child_hash", T.StringType())])
#: In JSON a pair is an array of two.
PAIR = T.ArrayType(T.StringType())
LIMIT_NAMES = ("cpu_milli", "memory_bytes", "pids_max", "io_read_bytes_per_sec", "io_write_bytes_per_sec", "wall_clock_secs")
LIMITS = T.StructType([T.StructField(n, U64) for n in LIMIT_NAMES])
SANDBOX_CONFIG = T.StructType([
    T.StructField("argv", T.ArrayType(T.StringType())), T.StructField("env", T.ArrayType(PAIR)), T.StructField("workdir", T.StringType()),
    T.StructField("stdin", T.StringType()), T.StructField("network", T.StringType()), T.StructField("limits", LIMITS),
    T.StructField("rootfs", T.StructType([T.StructField("ro_binds", T.ArrayType(PAIR)), T.StructField("tmpfs", T.ArrayType(PAIR)), T.StructField("symlinks", T.ArrayType(PAIR)), T.StructField("input_root", T.StringType())])),
    T.StructField("determinism", T.StructType([T.StructField("hostname", T.StringType()), T.StructField("timezone_utc", T.BooleanType()), T.StructField("source_date_epoch", T.LongType()), T.StructField("strip_ld_preload", T.BooleanType()), T.StructField("strip_path", T.BooleanType())])),
    T.StructField("retained_caps", T.ArrayType(T.StringType())), T.StructField("extra_seccomp_allow", T.ArrayType(T.StringType())),
])
ACCOUNTING = T.StructType([T.StructField(n, U64) for n in ("cpu_user_us", "cpu_system_us", "memory_peak_bytes", "io_read_bytes", "io_write_bytes", "max_pids")])
PROBE = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("detail", T.StringType())])
