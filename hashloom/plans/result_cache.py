"""Results of whole queries, by the digest of what made them; only finished ones are kept."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hashloom.sources import tables
from hashloom.sources.writing import replace


class ResultCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(operator: str, parameters: dict, inputs: list[str]) -> str:
        """Of the operator's name, its parameters and the digests of its inputs."""
        return hashlib.sha256(json.dumps([operator, parameters, inputs], sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def get(self, operator: str, parameters: dict, inputs: list[str], make: Callable[[], DataFrame], skip_lookup: bool = False) -> tuple[DataFrame, bool]:
        """The result and whether it was there. A failed run leaves nothing behind; a skipped lookup still stores."""
        path = f"{self.root}/{self.key(operator, parameters, inputs)}"
        if not skip_lookup and (version := tables.version_of(self.spark, path)):
            return self.spark.read.parquet(f"{path}/{version}"), True
        replace(make(), path)
        return self.spark.read.parquet(f"{path}/{tables.version_of(self.spark, path)}"), False
