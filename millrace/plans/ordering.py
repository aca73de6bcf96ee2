"""Row numbers without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


#: Rows of a range, which one task sorts.
RANGE_ROWS = 2_000_000


def numbered(df: DataFrame, *order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with place, from 1, in the order of the columns (which must tell all rows apart).

    Rows go to ranges of that order, which are written, as another run might draw their bounds elsewhere; each range is
    numbered by itself and starts after the rows of the ranges before it. There are as many ranges as rows ask for.
    """
    df = staged(df, "rows")
    ranges = max(-(-df.count() // rows), 1)
    r = staged(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = r.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    r = r.join(F.broadcast(before), F.col("__range") == F.col("__r"))  # one row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return r.withColumn("place", own + F.col("__before")).drop("__range", "__r", "__before")


def numbered_within(df: DataFrame, group: str, *order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with place, from 1 in each group, in the order of the columns. A hot group spreads over many ranges; what comes
    before a group is the smallest place of its rows."""
    n = staged(numbered(df, group, *order, rows=rows), "places")
    first = n.groupBy(F.col(group).alias("__group")).agg(F.min("place").alias("__first"))
    n = n.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return n.withColumn("place", F.col("place") - F.col("__first") + 1).drop("__group", "__first")
