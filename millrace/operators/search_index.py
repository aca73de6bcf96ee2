"""Search in a large library by a stored index of 3-grams.

Postings (gram, user_id, id) lie in folders by the gram's hash, sorted by gram, so that a search reads a few folders and of
these the row groups that may hold its grams. What they name are candidates, which are compared with LIKE as a scan would;
so an upsert only appends the postings of its rows, and those of former texts do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import search_products

C = F.col
FOLDERS = 64
FIELDS = ("sku", "name_zh", "name_en")
N = 3


def grams(text: Column) -> Column:
    """All runs of N characters, in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    at = F.when(F.length(t) >= N, F.sequence(F.lit(1), F.length(t) - N + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(t, i, F.lit(N)))


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def add_postings(products: DataFrame, folder: str) -> None:
    """Adds the postings of these products: of all to begin with, later of those that are new or changed. A frequent gram's
    postings are many tasks' work."""
    every = F.array_distinct(F.concat(*[grams(C(f)) for f in FIELDS]))
    p = products.select("user_id", "id", F.explode(every).alias("gram")).withColumn("folder", folder_of(C("gram")))
    order = ["folder", "gram", "user_id", "id"]
    p.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("folder").parquet(folder)


def needed_grams(keyword: str) -> list[str]:
    """Grams that every text must hold that is LIKE %keyword%: those of the runs between wildcards."""
    runs, i = [""], 0
    while i < len(keyword):
        if keyword[i] in "%_":
            runs.append("")
        else:
            i += keyword[i] == "\\" and i + 1 < len(keyword)
            runs[-1] += keyword[i]
        i += 1
    return sorted({r.lower()[k : k + N] for r in runs for k in range(len(r.lower()) - N + 1)})


def postings(spark: SparkSession, folder: str, user: str, wanted: list[str]) -> DataFrame:
    """The stored postings of some grams."""
    places = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(folder_of(C("gram"))).distinct().collect()]  # the keyword's
    stored = spark.read.schema("user_id string, id long, gram string, folder int").parquet(folder)
    return stored.where(C("folder").isin(places) & C("gram").isin(wanted) & (C("user_id") == user))


def indexed_search(products: DataFrame, folder: str, user: str, keyword: str, limit: int = 50) -> DataFrame:
    """What search_products gives, from the candidates that the index names. A keyword without N characters between
    wildcards is searched for in all products."""
    wanted = needed_grams(keyword)
    if not wanted:
        return search_products(products, user, keyword, limit)
    found = postings(products.sparkSession, folder, user, wanted).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(C("n") == len(wanted))
    return search_products(products.join(found.select("id"), "id", "left_semi"), user, keyword, limit)
