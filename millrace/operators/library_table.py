"""The library as a stored table that upserts change in place.

Rows lie in folders by a hash of their key and, within these, in buckets by the key. An upsert reads and rewrites the
folders that its keys fall into, and as buckets are what a join by key asks for, the library's rows aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import upsert

C = F.col
KEY = ["user_id", "sku"]
FOLDERS = 64
#: With this a write replaces the folders that it has rows for, once all of its tasks are done.
DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def folder_of(folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(folders)).cast("int").alias("folder")


def create_library(df: DataFrame, table: str, path: str, *, folders: int = FOLDERS, buckets: int = 200) -> None:
    """Stores df (without a column folder of its own) as a table at path; a folder has a file a bucket at most."""
    stored = df.select("*", folder_of(folders)).repartition(buckets, *KEY)
    stored.write.partitionBy("folder").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).option("folders", folders).saveAsTable(table)


def upsert_library(spark: SparkSession, table: str, incoming: DataFrame, fields: list[str], *, folders: int = FOLDERS) -> DataFrame:
    """Applies an upsert to the stored table and returns the frame that was written: the touched folders' rows. Other
    folders' files stay as they are; if the writing fails, so do these."""
    touched = sorted(r[0] for r in incoming.select(folder_of(folders)).distinct().collect())  # `folders` at most
    library = spark.table(table)
    own = library.where(C("folder").isin(touched)).drop("folder")
    out = upsert(own, incoming, fields).select("*", folder_of(folders)).select(*library.columns)
    before = spark.conf.get(DYNAMIC)
    spark.conf.set(DYNAMIC, "dynamic")
    try:
        out.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(DYNAMIC, before)
    return out
