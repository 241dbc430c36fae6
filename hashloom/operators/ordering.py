"""Positions in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, order: list[str], part: Column, out: str = "place") -> DataFrame:
    """``out``: the place of each row, from 1, in the order of ``order``.

    ``part`` must not fall as the order rises. Rows are counted by part, and numbered within
    theirs; only the counts, a row a part, are summed in one window.
    """
    rows = rows.withColumn("__part", part)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.withColumn("__own", own).join(before, "__part").withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def in_request_order(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows in the order of their requests, by a range-partitioned sort."""
    return rows.orderBy(pos)
