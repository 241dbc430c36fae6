"""Tables that the engine reads: stores, literals, documents of configuration and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom import schemas


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: The file that names the version which counts, in a table that is replaced as a whole.
POINTER = "_CURRENT"


def version_of(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version of the table at ``path``; None of a plain table or of none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return stream.readAllBytes().decode()
    finally:
        stream.close()


def open_store(spark: SparkSession, path: str, schema: T.StructType = schemas.BLOB) -> DataFrame:
    """A store's table, made empty where there is none; of one that is replaced as a whole, the current version."""
    if version := version_of(spark, path):
        return spark.read.schema(schema).parquet(f"{path}/{version}")
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    return open_store(spark, path, schemas.CACHED)


def memory_store(spark: SparkSession, rows: list[tuple], schema: T.StructType = schemas.BLOB) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def capabilities(spark: SparkSession) -> DataFrame:
    """One row: what the engine's protocol offers."""
    return spark.range(1).select(
        F.lit("SHA256").alias("digest_functions"), F.lit(True).alias("update_enabled"), F.lit(4 * 1024 * 1024).cast("long").alias("max_batch_total_size_bytes"),
        F.lit("DISALLOWED").alias("symlink_absolute_path_strategy"), F.lit(True).alias("exec_enabled"), F.lit("2.0").alias("low_api_version"), F.lit("2.3").alias("high_api_version"),
    )


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: each file's whole text, for counters and configuration."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """``path, data``: each file's bytes to its end."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def fetch(requests: DataFrame, store: DataFrame, schema: T.StructType) -> DataFrame:
    """Each request's blob read as a JSON message of ``schema``; a blob that isn't there, or isn't one, fails the query."""
    found = requests.join(store, ["hash", "size_bytes"], "left")
    body = F.coalesce(F.col("data"), F.raise_error(F.lit("blob not found")).cast("binary"))
    return found.select(requests.columns + [F.from_json(body.cast("string"), schema, {"mode": "FAILFAST"}).alias("message")])
