"""De-duplication and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import categories as C
from ..operators import dedup as D
from .registry import query

_SCORED = """
sc AS (SELECT *, CASE WHEN length(model) > 2 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(lower(spec_zh), 'charger|battery|motor|power|kw|voltage|ev') THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(spec_zh, 'warning|note|remark|spec|parameter') THEN 1 ELSE 0 END AS dedup_score FROM products_raw),
ky AS (SELECT *, regexp_replace(lower(model), '[-_\\s]', '', 'g') AS fuzzy_key, regexp_replace(trim(model), '\\s+', ' ', 'g') AS normalized_key,
  substr(md5(regexp_replace(replace(lower(spec_zh), '-', ':'), '\\s+', '', 'g')), 1, 8) AS spec_hash, CASE WHEN price_rmb <> 0 THEN price_rmb END AS p FROM sc WHERE dedup_score >= 0),
gr AS (SELECT *, count(*) OVER w AS n, min(spec_hash) OVER w <> max(spec_hash) OVER w AS differ, count(p) OVER w AS np, min(p) OVER w AS low, max(p) OVER w AS high FROM ky WINDOW w AS (PARTITION BY fuzzy_key)),
cf AS (SELECT *, n > 1 AND differ AND NOT (np >= 2 AND low > 0 AND coalesce(high / low < 1.05, false)) AS conflict FROM gr)"""
_MERGED = (
    _SCORED
    + """,
st AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN conflict THEN 'multi_spec' WHEN np >= 2 AND low > 0 AND high / low > 1.2 THEN 'price_split' ELSE 'merged' END AS dedup_status FROM cf),
ag AS (SELECT fuzzy_key AS fk, arg_max(model, length(model) * 100000000 - idx) AS bm, arg_max(spec_zh, length(spec_zh) * 100000000 - idx) AS bs, min(idx) AS first_idx, avg(p) AS mean_price,
  arg_min(normalized_key, idx) AS fn, arg_min(name_zh, idx) AS fname, arg_min(user_id, idx) AS fuser, coalesce(arg_min(image_path, idx) FILTER (image_path <> ''), '') AS fimg, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS fsrc FROM ky GROUP BY 1),
mg AS (SELECT idx, CASE WHEN dedup_status = 'merged' THEN bm ELSE model END AS model, CASE WHEN dedup_status = 'merged' THEN fn ELSE normalized_key END AS normalized_key, CASE WHEN dedup_status = 'merged' THEN bs ELSE spec_zh END AS spec_zh,
  CASE WHEN dedup_status = 'merged' THEN mean_price ELSE price_rmb END AS price_rmb, CASE WHEN dedup_status = 'merged' THEN fsrc ELSE source_file END AS source, fname AS name_zh, fuser AS user_id, fimg AS image_path, dedup_status
  FROM st JOIN ag ON fk = fuzzy_key WHERE dedup_status <> 'merged' OR idx = first_idx)"""
)
_SPLIT = (
    _MERGED
    + """,
pg AS (SELECT *, min(idx) OVER w AS fi, first_value(price_rmb) OVER (PARTITION BY normalized_key ORDER BY idx) AS fp, count(CASE WHEN price_rmb <> 0 THEN 1 END) OVER w AS np, min(CASE WHEN price_rmb <> 0 THEN price_rmb END) OVER w AS lo, max(CASE WHEN price_rmb <> 0 THEN price_rmb END) OVER w AS hi
  FROM mg WINDOW w AS (PARTITION BY normalized_key)),
ap AS (SELECT *, coalesce(fp IS NOT NULL AND np >= 2 AND lo > 0 AND hi / lo > 1.2, false) AS apart FROM pg),
dd AS (SELECT idx, model, normalized_key, spec_zh, round(price_rmb, 6) AS price_rmb, source, name_zh, user_id, image_path, CASE WHEN apart THEN 'price_split' ELSE dedup_status END AS dedup_status FROM ap WHERE apart OR idx = fi)"""
)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("price_rmb", F.round("price_rmb", 6))


@query("dedup_products", "products_raw", sql=_SPLIT + " SELECT * FROM dd")
def dedup_products(p):
    return _rounded(D.dedup_products(p))


@query("dedup_score_filter", "products_raw", sql=_SCORED + " SELECT idx, model, dedup_score FROM sc WHERE dedup_score >= 0")
def dedup_score_filter(p):
    return D.score_filter(p).select("idx", "model", "dedup_score")


@query("dedup_keys", "products_raw", sql=_SCORED + " SELECT idx, fuzzy_key, normalized_key, spec_hash FROM ky")
def dedup_keys(p):
    return D.with_keys(D.score_filter(p)).select("idx", "fuzzy_key", "normalized_key", "spec_hash")


@query("dedup_conflicts", "products_raw", sql=_SCORED + " SELECT idx, fuzzy_key, 'spec_mismatch' AS dedup_conflict FROM cf WHERE conflict")
def dedup_conflicts(p):
    return D.conflicts(D.with_keys(D.score_filter(p))).select("idx", "fuzzy_key", "dedup_conflict")


@query("dedup_merge", "products_raw", sql=_MERGED + " SELECT idx, model, normalized_key, spec_zh, round(price_rmb, 6) AS price_rmb, source, name_zh, user_id, image_path, dedup_status FROM mg")
def dedup_merge(p):
    return _rounded(D.merge(D.with_keys(D.score_filter(p))))


@query("dedup_price_split", "products_raw", sql=_SPLIT + " SELECT idx, normalized_key, dedup_status FROM dd")
def dedup_price_split(p):
    return D.price_split(D.merge(D.with_keys(D.score_filter(p)))).select("idx", "normalized_key", "dedup_status")


@query("dedup_status_counts", "products_raw", sql=_SPLIT + " SELECT dedup_status, count(*) AS n FROM dd GROUP BY 1 UNION ALL SELECT 'discarded', count(*) FROM sc WHERE dedup_score < 0")
def dedup_status_counts(p):
    gone = p.where(D.row_score(F.col("model"), F.col("spec_zh")) < 0).agg(F.lit("discarded").alias("dedup_status"), F.count(F.lit(1)).alias("n"))
    return D.dedup_products(p).groupBy("dedup_status").agg(F.count(F.lit(1)).alias("n")).unionByName(gone)


@query("price_cluster", "products", sql="""SELECT id, CASE WHEN coalesce(price_rmb, 0) = 0 OR price_usd = 0 THEN 'unknown' WHEN abs(price_rmb - price_usd * 8) / greatest(price_rmb, price_usd * 8) > 0.2 THEN 'version_split' ELSE 'same_cluster' END AS cluster,
  CASE WHEN coalesce(price_rmb, 0) = 0 OR price_usd = 0 THEN 'unknown' WHEN abs(price_rmb - price_usd * 6) / greatest(price_rmb, price_usd * 6) > 0.2 THEN 'version_split' ELSE 'same_cluster' END AS cluster6 FROM products""")  # fmt: skip
def price_cluster(p):
    return p.select("id", D.price_cluster(F.col("price_rmb"), F.col("price_usd") * 8).alias("cluster"), D.price_cluster(F.col("price_rmb"), F.col("price_usd") * 6).alias("cluster6"))


@query("normalize_hash_text", "texts", sql="SELECT id, regexp_replace(replace(lower(coalesce(spec, '')), '-', ':'), '[_\\s]', '', 'g') AS hash_text FROM texts")
def normalize_hash_text(t):
    return t.select("id", D.hash_text(F.col("spec")).alias("hash_text"))


@query("duplicate_models", "products_raw", sql="SELECT idx, model, count(*) OVER (PARTITION BY model) AS n FROM products_raw QUALIFY n > 1")
def duplicate_models(p):
    n = p.groupBy("model").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return p.join(n, "model").select("idx", "model", "n")


def _category_sql(text: str) -> str:
    parts = []
    for name, words in C.CATEGORIES.items():
        if words:
            parts.append(f"SELECT k.*, '{name}' AS name, " + " + ".join(f"CASE WHEN contains(t, '{w}') THEN {len(w)} ELSE 0 END" for w in words) + " AS score FROM k")
    return f"k AS (SELECT *, lower({text}) AS t FROM products_raw), u AS ({' UNION ALL '.join(parts)}), b AS (SELECT idx, arg_max(CASE WHEN score > 0 THEN name ELSE 'Other' END, lpad(CAST(score AS VARCHAR), 6, '0') || name) AS category FROM u GROUP BY idx)"


_TEXT = "concat_ws(' ', nullif(model, ''), nullif(name_zh, ''), nullif(spec_zh, ''))"


def categorised(p: DataFrame) -> DataFrame:
    return p.withColumn("category", C.predict_category(C.row_text("model", "name_zh", "spec_zh")))


@query("predict_category", "products_raw", sql=_category_sql(_TEXT) + " SELECT idx, category FROM b")
def predict_category(p):
    return categorised(p).select("idx", "category")


@query("category_stats", "products_raw", sql=_category_sql(_TEXT) + " SELECT category, count(*) AS n FROM b GROUP BY 1")
def category_stats(p):
    return categorised(p).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("sort_by_category", "products_raw", sql=_category_sql("name_zh") + " SELECT idx, row_number() OVER (ORDER BY CASE category WHEN 'Electric Vehicle' THEN 0 WHEN 'Auto Parts' THEN 1 WHEN 'Medical' THEN 2 WHEN 'Chemicals' THEN 3 WHEN 'Electronics' THEN 4 WHEN 'Office' THEN 5 WHEN 'Other' THEN 6 ELSE 999 END, idx) - 1 AS place FROM b")
def sort_by_category(p):
    """Numbered through zipWithIndex-like offsets: rows are counted per category, so that no task sorts them all."""
    d = p.select("idx", C.category_rank(C.predict_category(F.col("name_zh"))).alias("rank"))
    from .ordering import numbered

    return numbered(d, "rank", "idx").select("idx", (F.col("place") - 1).alias("place"))


def categorised_counts(p: DataFrame) -> DataFrame:
    return categorised(D.dedup_products(p)).groupBy("category", "dedup_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price_rmb"), 4).alias("mean_price"))


@query("library_clean_flow", "products_raw", sql=_SPLIT + ", " + _category_sql(_TEXT).replace("FROM products_raw", "FROM dd") + " SELECT category, dedup_status, count(*) AS n, round(avg(price_rmb), 4) AS mean_price FROM b JOIN dd USING (idx) GROUP BY 1, 2")
def library_clean_flow(p):
    return categorised_counts(p)
