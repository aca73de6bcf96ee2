"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where its content says so, each chunk gets an identifier, and a document becomes the ordered
list of its chunks' identifiers, about 3 % of its bytes. Lists are compared instead of texts. The identifier is a 64-bit
hash that is verified: the distinct chunks are brought together once, and should one hash stand for two different
chunks, those chunks get identifiers that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage

#: A chunk has 256 characters at least and ends at the next letter before punctuation, or at 2048 characters.
CHUNK = r"(?s).{255,2046}?\p{L}(?=\p{P})|.{1,2048}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def clashes(texts: DataFrame, norm: str, pattern: str = CHUNK, hashed=chunk_hash) -> DataFrame | None:
    """(h, chunk, variant) for every hash that stands for several different chunks, None if there is no such hash;
    variants count from 0 in chunk order.

    Each distinct chunk leaves a map task once; equality is that of the grouped bytes. Only hashes are counted then.
    """
    c = texts.select(F.explode(chunks(F.col(norm), pattern)).alias("chunk"))
    c = c.select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    several = stage(c.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(F.col("h").alias("sh")), "dedup-clashes")
    if several.isEmpty():
        return None
    c = c.join(several, F.col("h") == F.col("sh"), "left_semi")
    return stage(c.withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1), "dedup-variants")


def exact_dedup(docs: DataFrame, *, text="text", doc_id="doc_id", pattern: str = CHUNK, hashed=chunk_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same but for ASCII white space; null counts as empty, and all empty texts are one
    group. The row with most code points in the original text stays, of those the smallest doc_id (null last); of rows
    that repeat that id and length too, one. Other columns of docs are left out. An empty table gives an empty table.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("doc_id", F.length("t").alias("n"), normalised(F.col("t")).alias("norm"))
    odd = clashes(d, "norm", pattern, hashed)
    ids = F.transform(chunks(F.col("norm"), pattern), hashed)
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    if odd is None:
        rows = d.select("doc_id", "n", ids.alias("recipe"), sha.alias("text_sha256"))
    else:
        rows = told_apart(d.select("doc_id", "n", "norm", sha.alias("text_sha256")), odd, pattern, hashed)
    # a number tells rows apart that repeat id and length; once written it stays
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-recipes")

    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = rows.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = stage(groups.select(F.xxhash64("recipe").alias("gh"), F.col("recipe").alias("g"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "dedup-groups")
    joined = rows.join(groups, (F.xxhash64("recipe") == F.col("gh")) & (F.col("recipe") == F.col("g")), "left")
    alone = F.col("g").isNull()
    stays = alone | (F.col("row") == F.col("keep_row"))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        "text_sha256",
    )


def told_apart(d: DataFrame, odd: DataFrame, pattern: str, hashed) -> DataFrame:
    """Recipes with a variant added to each clashing hash; documents without one keep theirs. Rows are joined back by
    their text's digest, so a text is worked through once however often it occurs."""
    texts = d.groupBy("text_sha256").agg(F.first("norm").alias("norm"))
    c = texts.select("text_sha256", F.posexplode(chunks(F.col("norm"), pattern)).alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk")))
    c = c.join(odd.withColumnRenamed("h", "oh").withColumnRenamed("chunk", "oc"), (F.col("h") == F.col("oh")) & (F.col("chunk") == F.col("oc")), "left")
    c = c.select("text_sha256", F.struct("pos", "h", F.coalesce("variant", F.lit(0)).cast("long").alias("v")).alias("x"))
    lists = c.groupBy("text_sha256").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    flat = F.flatten(F.transform("xs", lambda x: F.array(x["h"], x["v"]))).alias("recipe")
    lists = lists.select(F.col("text_sha256").alias("key"), flat)
    none = F.array().cast("array<bigint>")
    return d.join(lists, F.col("text_sha256") == F.col("key"), "left").select("doc_id", "n", F.coalesce("recipe", none).alias("recipe"), "text_sha256")
