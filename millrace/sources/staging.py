"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's own setting by which a write deletes the shuffle files that only it needed.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of applications that have none in their settings.
_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the
    driver runs all tasks itself (tests); on a cluster a folder of the driver's would be another one on each machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN:
        _OWN[own] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[own]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, however often it is read, and files survive a
    lost executor."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def staged_in_parts(build: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str, *keys: str, parts: int = 4) -> DataFrame:
    """build(rows) as staged, for a build that has no use for rows of two keys at once: rows whose keys have one hash are
    worked out and written, and the shuffle files of that go before the next part, so that those of one part are on the disks
    at a time. The session's setting for that is put back."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        for k in range(parts):
            part = build(rows.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == k))
            part.write.mode("append").option("compression", "zstd").parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(part.schema).parquet(folder)


def clear(spark: SparkSession, name: str | None = None, older_than: float = 0.0) -> int:
    """Deletes tables between steps (of one name, else of all names) that were last written `older_than` seconds ago or
    earlier, and returns how many. For the folder's owner, once no DataFrame that reads them is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return 0
    latest, n = (time.time() - older_than) * 1000, 0
    for f in files.listStatus(path):
        found = re.fullmatch(r"(.+)-[0-9a-f]{32}", f.getPath().getName())
        if found and name in (None, found[1]) and f.getModificationTime() <= latest:
            files.delete(f.getPath(), True)
            n += 1
    return n
