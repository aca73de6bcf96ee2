"""Output in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_key(column: Column, default: str = "Uncategorized") -> Column:
    return F.coalesce(F.when(column != "", column), F.lit(default))


def write_groups(df: DataFrame, path: str, column: str, order: str = "model", files_per_group: int = 8) -> None:
    """One folder per group, each sorted. A group spreads over files_per_group tasks, so that a hot one is not one task's work."""
    d = df.withColumn("group", group_key(F.col(column)))
    salt = F.pmod(F.xxhash64(order), F.lit(files_per_group))
    d.repartition("group", salt).sortWithinPartitions("group", order).write.partitionBy("group").mode("overwrite").parquet(path)
