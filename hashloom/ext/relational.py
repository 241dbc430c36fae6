"""As-of and range joins, and windows of event time, as compositions of built-in operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], part: str) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key that is not later.

    One union and one sort within each ``part`` of a key (a column of both sides that doesn't fall as
    time rises), and a short window over the parts' last values, so a key with very many rows is
    spread over its parts.
    """
    kept = [c for c in left.columns if c not in (*by, time, part)]
    a = left.select(*by, time, part, F.lit(1).alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__v"))
    b = right.select(*by, time, part, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    both = a.unionByName(b)
    within = Window.partitionBy(*by, part).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    ends = b.groupBy(*by, part).agg(F.max_by("__v", time).alias("__end"))
    parts = both.select(*by, part).distinct().join(ends, [*by, part], "left")
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, part, F.last("__end", ignorenulls=True).over(before).alias("__before"))
    seen = both.withColumn("__own", F.last("__v", ignorenulls=True).over(within)).where("__side = 1").join(carried, [*by, part])
    got = F.coalesce("__own", "__before")
    return seen.select(*by, time, *[F.col(f"__row.{c}").alias(c) for c in kept], *[got[v].alias(v) for v in values])


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points within ``[low, high)`` of each range: an equi-join on cells of ``width``, not a product. A range meets as many cells as it is wide."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def sessions(events: DataFrame, by: list[str], time: str, gap: str, *aggregates: Column) -> DataFrame:
    return events.groupBy(*by, F.session_window(time, gap).alias("w")).agg(*aggregates).withColumn("start", F.col("w.start")).withColumn("end", F.col("w.end")).drop("w")


def tumbling(events: DataFrame, by: list[str], time: str, width: str, *aggregates: Column) -> DataFrame:
    return events.groupBy(F.window(time, width).alias("w"), *by).agg(*aggregates).withColumn("start", F.col("w.start")).drop("w")
