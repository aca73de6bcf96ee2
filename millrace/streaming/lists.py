"""Suppliers' lists as they arrive in a folder: parsed once, broken files set aside, read files moved to an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import ROW
from .streams import run_batches

C = F.col


def list_stream(spark: SparkSession, folder: str, schema: str = ROW, *, archive: str | None = None, per_trigger: int | None = None, endings: str = "*.csv") -> DataFrame:
    """Rows of the CSV lists that arrive in a folder, with source_file, modified and __corrupt (a line that doesn't fit its
    list). A path is read once. archive: read files are moved there once their trigger's rows are committed."""
    read = spark.readStream.schema(f"{schema}, __corrupt string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").option("pathGlobFilter", endings)
    if archive:
        read = read.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if per_trigger:
        read = read.option("maxFilesPerTrigger", per_trigger)
    return read.csv(folder).select("*", C("_metadata.file_path").alias("source_file"), C("_metadata.file_modification_time").alias("modified"))


def sorted_out(rows: DataFrame, most_bad: float) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad files): a file is bad, and none of its rows is good, if over `most_bad` of its lines don't fit."""
    files = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"), F.count("__corrupt").alias("n_bad"), F.max("modified").alias("modified"))
    bad = files.where(C("n_bad") > most_bad * C("n_lines"))
    good = rows.where("__corrupt is null").join(bad.select("source_file"), "source_file", "left_anti").drop("__corrupt", "modified")
    return good, bad


def ingest_lists(lists: DataFrame, folder: str, most_bad: float = 0.0) -> None:
    """Runs a list_stream over what is there now: folder/good and folder/bad get each trigger's rows and bad files under the
    trigger's number, so that a repeated trigger overwrites its own. A later call with the same folder goes on from there."""

    def put(rows: DataFrame, n: int) -> None:
        rows.persist()  # the files are read once for both
        good, bad = sorted_out(rows, most_bad)
        good.write.mode("overwrite").parquet(f"{folder}/good/trigger={n}")
        bad.write.mode("overwrite").parquet(f"{folder}/bad/trigger={n}")
        rows.unpersist()

    run_batches(lists, folder, put)


def ingested(spark: SparkSession, folder: str, schema: str = ROW) -> tuple[DataFrame, DataFrame]:
    """(rows, bad files) of all triggers so far."""
    good = spark.read.schema(f"source_file string, {schema}, trigger long").parquet(f"{folder}/good")
    bad = spark.read.schema("source_file string, n_lines long, n_bad long, modified timestamp, trigger long").parquet(f"{folder}/bad")
    return good, bad
