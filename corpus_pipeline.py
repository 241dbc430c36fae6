"""A corpus from raw documents: five stages, each an operator of ``hashloom.llm``.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm import exact_dedup, near_dedup, packing, pii, toxicity
from hashloom.llm.common import drop, free_shuffles, scratch, scratched, table, written_to


#: Scratch tables by the place of the stage that made them.
_left: list[tuple[int, str]] = []


def _place(k: int):
    """A stage's function: what the stages before it kept in the shared folder goes first, as their results are written by then."""

    def of(stage):
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            free_shuffles(spark)
            for place, path in list(_left):
                if place < k:
                    drop(spark, path)
                    _left.remove((place, path))
            before = scratched()
            result = stage(spark, docs, sf_dir)
            _left.extend((k, path) for path in scratched() - before)
            return result

        return run

    return of


@_place(0)
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the labels' own documents fit the model. Null and empty texts have no evidence: they stay unless such labels are mostly toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_place(1)
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest id; a null id is below all others."""
    return exact_dedup.without_copies(docs)


@_place(2)
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, a null id above all others; null and empty texts are one group."""
    return near_dedup.representatives(docs)


@_place(3)
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and ``n_chars`` set to the new length; null texts stay null."""
    return pii.redacted(docs)


@_place(4)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows; a null or empty text is the one end id."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: SQL can express neither the models of the first stage nor near duplicates; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes once the next one's is written; the last stage reads the one that is left."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}", keep=True)
        docs = written_to(stage(spark, docs, sf_dir), path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
