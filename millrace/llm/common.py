"""What the operators of this subpackage share: word rules and tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_base

#: A word is a run of anything but ASCII white space. Python's bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


#: Spark's own setting by which a write deletes the shuffle files that only it needed; otherwise they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads start from files that survive a lost executor.

    The shuffle files of the writing go when it ends; the session's setting for that is put back."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more: what was made of them has been staged itself."""
    for df in staged:
        if df is not None:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_id(doc_id) -> Column:
    """An id on its way through Python, as text: pandas would turn a column of whole numbers with a null among them into
    doubles, which hold no more than 53 bits. It is cast back to its own type behind the Python function."""
    return F.col(doc_id).cast("string").alias("doc_id")


#: Rows go to Python functions in batches of so many bytes, whatever the texts' lengths; the session's default is 256 MB.
BATCH_BYTES = "8m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands rows to Python in batches that fit a task's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
