"""Product de-duplication: score, keys, conflicts within a fuzzy key, merge, price split.

Each grouping is an aggregation with partial sums whose result is joined back, so that a key with very many rows is
never gathered; its rows meet only that key's one summary row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Fixed words of the scoring rule.
PRODUCT_WORDS = ("charger", "battery", "motor", "power", "kw", "voltage", "ev")
NOISE_WORDS = ("warning", "note", "remark", "spec", "parameter")
CONFLICT_RATIO = 1.05
MERGE_RATIO = 1.2


def _has_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def row_score(model: Column, spec: Column) -> Column:
    model, spec = F.coalesce(model, F.lit("")), F.coalesce(spec, F.lit(""))
    return F.when(F.length(model) > 2, 1).otherwise(0) + F.when(_has_any(F.lower(spec), PRODUCT_WORDS), 2).otherwise(0) - F.when(_has_any(spec, NOISE_WORDS), 1).otherwise(0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fuzzy_key(model: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(model, F.lit(""))), r"[-_\s]", "")


def normalized_key(model: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(model, F.lit(""))), r"\s+", " ")


def spec_hash(spec: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(spec, F.lit(""))), "-", ":"), r"\s+", "")
    return F.substring(F.md5(plain.cast("binary")), 1, 8)


def hash_text(text: Column) -> Column:
    """Lower case, "-" as ":", without white space and underscores."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "-", ":"), r"[_\s]", "")


def price_cluster(a: Column, b: Column, threshold: float = 0.20) -> Column:
    known = (F.coalesce(a, F.lit(0.0)) != 0) & (F.coalesce(b, F.lit(0.0)) != 0)
    return F.when(~known, "unknown").when(F.abs(a - b) / F.greatest(a, b) > threshold, "version_split").otherwise("same_cluster")


def _usable(price: Column) -> Column:
    """The price, null where it is zero or not a number."""
    return F.when((price != 0) & ~F.isnan(price), price)


def score_filter(df: DataFrame, threshold: int = 0) -> DataFrame:
    return df.withColumn("dedup_score", row_score(F.col("model"), F.col("spec_zh"))).where(F.col("dedup_score") >= threshold)


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"fuzzy_key": fuzzy_key(F.col("model")), "normalized_key": normalized_key(F.col("model")), "spec_hash": spec_hash(F.col("spec_zh"))})


def groups(df: DataFrame, *more: Column) -> DataFrame:
    """One row per fuzzy key with what its rows' fate depends on. df: with_keys. more: further aggregates."""
    p = _usable(F.col("price_rmb"))
    return df.groupBy("fuzzy_key").agg(
        F.count(F.lit(1)).alias("n"), (F.min("spec_hash") != F.max("spec_hash")).alias("specs_differ"), F.count(p).alias("n_prices"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean_price"),
        F.min("idx").alias("first_idx"), *more,
    ).withColumn("conflict", _conflict())


def _conflict() -> Column:
    close = (F.col("n_prices") >= 2) & (F.col("low") > 0) & (F.col("high") / F.col("low") < CONFLICT_RATIO)
    return (F.col("n") > 1) & F.col("specs_differ") & ~close


def conflicts(df: DataFrame) -> DataFrame:
    """Rows of fuzzy keys whose specifications disagree. df: with_keys."""
    return df.join(groups(df).where("conflict").select("fuzzy_key"), "fuzzy_key", "left_semi").withColumn("dedup_conflict", F.lit("spec_mismatch"))


def merge(df: DataFrame) -> DataFrame:
    """Rows after step 5. df: with_keys. A key's extra columns and image come from its first rows for all its rows."""
    split = (F.col("n_prices") >= 2) & (F.col("low") > 0) & (F.col("high") / F.col("low") > MERGE_RATIO)
    status = F.when(F.col("n") == 1, "single").when(F.col("conflict"), "multi_spec").when(split, "price_split").otherwise("merged")
    longest = lambda c: F.max_by(F.col(c), F.when(F.length(c) > 0, F.struct(F.length(c), -F.col("idx"))))
    g = groups(
        df, longest("model").alias("best_model"), longest("spec_zh").alias("best_spec"), F.min_by(F.struct("normalized_key", "name_zh", "user_id"), "idx").alias("first"),
        F.min_by("image_path", F.when(F.col("image_path") != "", F.col("idx"))).alias("first_image"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("source_file") != "", F.col("source_file")))), ",").alias("sources"),
    )
    rows = df.join(g, "fuzzy_key").withColumn("dedup_status", status)
    one = F.col("dedup_status") == "merged"
    rows = rows.where(~one | (F.col("idx") == F.col("first_idx")))
    pick = lambda merged, own: F.when(one, merged).otherwise(own)
    return rows.select(
        "idx", pick(F.coalesce("best_model", F.lit("")), F.col("model")).alias("model"), pick(F.col("first.normalized_key"), F.col("normalized_key")).alias("normalized_key"),
        pick(F.coalesce("best_spec", F.lit("")), F.col("spec_zh")).alias("spec_zh"), pick(F.col("mean_price"), F.col("price_rmb")).alias("price_rmb"), pick(F.col("sources"), F.col("source_file")).alias("source"),
        F.col("first.name_zh").alias("name_zh"), F.col("first.user_id").alias("user_id"), F.coalesce("first_image", F.lit("")).alias("image_path"), "dedup_status",
    )


def price_split(merged: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Rows after step 6: all rows of a key whose prices lie apart, else its first row."""
    p = _usable(F.col("price_rmb"))
    g = merged.groupBy("normalized_key").agg(F.min("idx").alias("first_idx"), F.min_by("price_rmb", "idx").alias("first_price"), F.count(p).alias("n_prices"), F.min(p).alias("low"), F.max(p).alias("high"))
    apart = F.col("first_price").isNotNull() & (F.col("n_prices") >= 2) & (F.col("low") > 0) & (F.col("high") / F.col("low") > 1 + threshold)
    g = g.select("normalized_key", "first_idx", F.coalesce(apart, F.lit(False)).alias("apart"))
    rows = merged.join(g, "normalized_key").where(F.col("apart") | (F.col("idx") == F.col("first_idx")))
    return rows.withColumn("dedup_status", F.when(F.col("apart"), "price_split").otherwise(F.col("dedup_status"))).drop("first_idx", "apart")


def dedup_products(df: DataFrame, price_threshold: float = 0.20, score_threshold: int = 0) -> DataFrame:
    """The whole chain. df: idx (unique), model, name_zh, spec_zh, price_rmb, source_file, image_path, user_id.

    The rows after merging are written once, as they are read twice."""
    return price_split(staged(merge(with_keys(score_filter(df, score_threshold))), "merged"), price_threshold)
