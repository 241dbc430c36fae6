"""Running commands as Spark tasks, and what surrounds a run.

``execute`` is the whole path of a submitted command: build the action, upload
what the store lacks, probe the cache, run what misses, store the outputs,
remember successes.
"""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions import digests, status
from hashloom.operators import resolving, results, store
from hashloom.operators.store import EMPTY
from hashloom.sources.shared import kept

OUTCOME = "action_hash string, exit_code int, stdout binary, stderr binary"


def actions(commands: DataFrame) -> DataFrame:
    """``commands(seq, argv, skip)`` with the canonical text and digest of each command and action; the input root is empty."""
    argv = F.transform("argv", lambda a: F.concat(F.octet_length(a).cast("string"), F.lit(":"), a, F.lit(";")))
    body = F.concat(F.lit("argv;"), F.array_join(argv, ""))
    made = commands.withColumn("command", body).withColumn("command_hash", digests.hash_of(F.col("command")))
    return made.withColumn("action", resolving.canonical(F.col("command_hash"), F.lit(EMPTY))).withColumn("action_hash", digests.hash_of(F.col("action")))


def blobs_of(made: DataFrame) -> DataFrame:
    """What a submission uploads: the command and the action of each row."""
    parts = made.select(F.explode(F.array("command", "action")).alias("text"))
    return store.as_blobs(parts, F.col("text"))


def processes(argv_rows: DataFrame, timeout: float | None = None) -> DataFrame:
    """Run ``argv`` of each row ``action_hash, argv`` as a process of its task. A program that isn't there exits 127, a signal is -1."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, argv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    done = subprocess.run(argv, capture_output=True, timeout=timeout, stdin=subprocess.DEVNULL)
                    rows.append((name, done.returncode if done.returncode >= 0 else -1, done.stdout, done.stderr))
                except FileNotFoundError as e:
                    rows.append((name, 127, b"", str(e).encode()))
                except subprocess.TimeoutExpired as e:
                    rows.append((name, -1, e.stdout or b"", b"timed out"))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], ["action_hash", "exit_code", "stdout", "stderr"])

    return argv_rows.select("action_hash", "argv").mapInArrow(run, OUTCOME)


def execute(commands: DataFrame, cache: DataFrame, blobs: DataFrame, runner=processes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(outcomes, cache, blobs)`` of one batch of commands ``seq, argv, skip``.

    ``cache`` has ``action_hash, exit_code, stdout, stderr``; the returned one has this batch's successes too.
    Requests of one batch don't see each other's results, as requests in flight don't: each distinct missing
    action runs once and all its requests get the outcome. It runs when this is called, not when a result is read:
    what ran is written to the shared folder, and outcomes, cache and blobs are made from that. (Spark may run a
    task again that failed or was lost with its executor.)
    """
    made = actions(commands)
    _, blobs = store.batch_update(blobs, store.to_upload(blobs_of(made), blobs).withColumn("pos", F.lit(0).cast("long")))
    seen = results.probe(made, cache, "action_hash", bypass=F.col("skip"))
    misses = seen.where(~F.col("cache_hit")).select("action_hash", "argv").dropDuplicates(["action_hash"])
    ran = kept(runner(misses), "ran")
    fresh = seen.where(~F.col("cache_hit")).select("seq", "action_hash", "cache_hit").join(ran, "action_hash")
    held = seen.where("cache_hit").select("seq", "action_hash", "cache_hit", "exit_code", "stdout", "stderr")
    outcomes = held.unionByName(fresh)
    outputs = store.as_blobs(ran.select(F.explode(F.array("stdout", "stderr")).alias("data")), F.col("data"))
    _, blobs = store.batch_update(blobs, store.to_upload(outputs, blobs).withColumn("pos", F.lit(0).cast("long")))
    good = ran.where(F.col("exit_code") == status.OK)
    return outcomes, cache.join(good.select("action_hash"), "action_hash", "left_anti").unionByName(good), blobs
