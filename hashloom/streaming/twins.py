"""Streaming twins of the stateful operators.

Each takes streaming DataFrames and returns one; :func:`drained` runs a query over
what there is and returns the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.operators import dispatching, results
from hashloom.sources.shared import fresh_path

REPLAYED = "event_id long, hit boolean, source_id long, replayed_exit int"


def source(spark: SparkSession, root: str, name: str, schema, max_files: int | None = None) -> DataFrame:
    """A table's files as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{root}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over the rows that are there now, into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def matched(jobs: DataFrame, reports: DataFrame, key: str, time: str, wait: str = "1 hour") -> DataFrame:
    """Reports joined to the jobs that wait for them. The watermarks bound what is remembered; a report without a job is dropped."""
    left = jobs.withWatermark(time, wait).alias("j")
    right = reports.withWatermark(f"report_{time}", wait).alias("r")
    near = (F.col(f"r.report_{time}") >= F.col(f"j.{time}") - F.expr(f"interval {wait}")) & (F.col(f"r.report_{time}") <= F.col(f"j.{time}") + F.expr(f"interval {wait}"))
    return left.join(right, (F.col(f"j.{key}") == F.col(f"r.report_{key}")) & near, "inner")


def first_of(stream: DataFrame, *keys: str) -> DataFrame:
    """Idempotent insert: the first row of each key goes through."""
    return stream.dropDuplicates(list(keys))


def replay(log: DataFrame) -> DataFrame:
    """The replay of a request log ``user_id, ts, event_id, exit_code, skip`` to its end, micro-batch by micro-batch.

    A micro-batch is replayed in the order of ``ts, event_id`` by the operator of tables, which spreads out a
    key with very many rows, after the result stored for each key by the batches before. What is stored is a
    table a batch in the shared folder; a batch that runs again reads the same one and writes over its own.
    A row that comes in a later batch than its time is replayed where it came.
    """
    spark = log.sparkSession
    base = fresh_path(spark, "replay")
    state = T.StructType([log.schema["user_id"], T.StructField("stored", T.LongType()), T.StructField("at", T.LongType())])

    done: set[int] = set()

    def step(batch: DataFrame, number: int) -> None:
        done.add(number)
        session = batch.sparkSession
        held = session.read.schema(state).parquet(f"{base}/state/{number - 1}") if number else session.createDataFrame([], state)
        batch = batch.select("user_id", "ts", "event_id", "exit_code", "skip")
        seeds = held.select("user_id", F.lit(None).cast(batch.schema["ts"].dataType).alias("ts"), F.col("stored").alias("event_id"), F.lit(0).alias("exit_code"), F.lit(True).alias("skip"), F.lit(0).alias("turn"))
        rows = batch.withColumn("turn", F.lit(1)).unionByName(seeds)
        rows = rows.withColumn("seq", F.struct("turn", "ts", "event_id")).withColumn("part", F.struct("turn", F.to_date("ts").alias("day")))
        seen = results.replay(rows, "user_id", "seq", "part")
        out = seen.where("turn = 1").select("event_id", "hit", F.col("source_seq.event_id").alias("source_id"), "replayed_exit")
        out.write.mode("overwrite").parquet(f"{base}/out/{number}")
        stores = seen.where("not hit and exit_code = 0").groupBy("user_id").agg(F.max_by("event_id", "seq").alias("stored"))
        stores.select("user_id", F.col("stored").cast("long").alias("stored"), F.lit(number).cast("long").alias("at")).write.mode("overwrite").parquet(f"{base}/state/{number}")

    query = log.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(REPLAYED).parquet(*[f"{base}/out/{n}" for n in sorted(done)]) if done else spark.createDataFrame([], REPLAYED)


def operations(submissions: DataFrame, cache: DataFrame, reports: DataFrame) -> DataFrame:
    """One finished operation for each streamed submission ``job_id, action``, held against a table of results and one of workers' reports.

    A cached action answers at once; another one waits for its report. A submission with neither gets nothing.
    """
    held = cache.select("action", F.struct(F.col("exit_code")).alias("kept"))
    said = reports.withColumnRenamed("job_id", "reported")
    seen = submissions.join(held, "action", "left").join(said, F.col("job_id") == F.col("reported"), "left")
    hit = F.col("kept").isNotNull()
    seen = seen.where(hit | F.col("reported").isNotNull()).withColumn("cache_hit", hit).withColumn("problem", F.when(~hit, dispatching.problem_of(F.col("error_message"), F.col("result"))))
    return dispatching.operations(seen.withColumn("result", F.when(hit, F.col("kept")).otherwise(F.col("result"))))
