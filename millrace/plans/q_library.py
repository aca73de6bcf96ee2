"""Library lists, searches, lookups, orders, table changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dictionary import WORDS
from ..functions.language import longest_first
from ..functions.prices import rounded
from ..operators import imports as I
from ..operators import library as L
from ..operators import library_table as T
from ..operators import search_index as X
from ..operators.grouping import group_key
from ..sources import files
from ..sources.staging import shared_folder, staged
from .ordering import numbered_within
from .q_scalars import _NUMBER, _WHOLE, _packed
from .registry import query


def rows() -> Column:
    return F.count(F.lit(1))


def ids_of(p, mod):
    """Ids that a request would name: a selection made by the request, not a cut of the input."""
    return p.where(F.col("id") % mod == 0).select("id")


@query("list_products", "products", sql="SELECT id, sku, updated_at FROM products WHERE user_id = 'u3' AND category = 'cat2' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 5")
def list_products(p):
    return L.list_products(p, "u3", "cat2", 20, 5).select("id", "sku", "updated_at")


@query("search_products", "products", sql="""SELECT id, CASE WHEN sku ILIKE '%R_n%' THEN 1 WHEN name_zh ILIKE '%R_n%' THEN 2 ELSE 3 END AS rank FROM products
  WHERE user_id = 'local' AND (sku ILIKE '%R_n%' OR name_zh ILIKE '%R_n%' OR name_en ILIKE '%R_n%') ORDER BY rank, id LIMIT 50""")  # fmt: skip
def search_products(p):
    return L.search_products(p, "local", "R_n").select("id", "rank")


_LIKE = "ILIKE '%Sing%re_%'"


@query("search_indexed", "products", "incoming", sql=f"""n AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY user_id, sku ORDER BY id DESC) = 1),
l AS (SELECT p.id, p.user_id, p.sku, p.name_en, CASE WHEN n.id IS NULL THEN p.name_zh ELSE n.name_zh || ' Rising-Red' END AS name_zh FROM products p LEFT JOIN n ON n.user_id = p.user_id AND n.sku = p.sku
  UNION ALL SELECT id, user_id, sku, NULL, name_zh || ' Rising-Red' FROM n WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.user_id = n.user_id AND p.sku = n.sku))
SELECT id, CASE WHEN sku {_LIKE} THEN 1 WHEN name_zh {_LIKE} THEN 2 ELSE 3 END AS rank FROM l WHERE user_id = 'local' AND (sku {_LIKE} OR name_zh {_LIKE} OR name_en {_LIKE}) ORDER BY rank, id LIMIT 50""")
def search_indexed(p, new):
    """A search by the stored index, after an upsert that gives rows another name."""
    folder = shared_folder(p.sparkSession, "grams")
    X.add_postings(p, folder)
    new = new.withColumn("name_zh", F.concat("name_zh", F.lit(" Rising-Red")))
    library = staged(L.upsert(p, new, ["name_zh"]).select("id", "user_id", "sku", "name_zh", "name_en"), "library")
    X.add_postings(library.join(new.select("user_id", "sku").distinct(), ["user_id", "sku"], "left_semi"), folder)
    return X.indexed_search(library, folder, "local", "Sing%re_").select("id", "rank")


@query("search_substring", "products_raw", sql="SELECT idx FROM products_raw WHERE contains(lower(model), 'ab-1') OR contains(lower(name_zh), 'ab-1')")
def search_substring(p):
    return L.search_substring(p, "AB-1", "model", "name_zh").select("idx")


@query("filter_price_range", "products", sql="SELECT id FROM products WHERE price_rmb IS NOT NULL AND price_rmb >= 950 AND price_rmb <= 1050.5")
def filter_price_range(p):
    return p.where(L.price_between(F.col("price_rmb"), 950, 1050.5)).select("id")


@query("filter_keyword", "products", sql="SELECT id FROM products WHERE (contains(lower(name_zh), 'ring') OR contains(lower(name_zh), 'red')) AND NOT contains(lower(name_en), 'promo')")
def filter_keyword(p):
    return p.where(L.keyword_filter(F.col("name_zh"), ["Ring", "RED"]) & L.keyword_filter(F.col("name_en"), ["promo"], include=False)).select("id")


@query("filter_cert", "products", sql="SELECT id FROM products WHERE contains(upper(coalesce(cert, '')), 'ROHS') OR contains(upper(coalesce(cert, '')), 'FCC')")
def filter_cert(p):
    return p.where(L.cert_filter(F.col("cert"), ["RoHS", "fcc"])).select("id")


@query("filter_regex", "products", sql="SELECT id FROM products WHERE regexp_matches(sku, '^SKU-1[0-9]+$')")
def filter_regex(p):
    return p.where(L.regex_filter(F.col("sku"), "^SKU-1[0-9]+$")).select("id")


@query("filter_chain", "products", sql="SELECT id FROM products WHERE price_rmb >= 920 AND contains(lower(name_zh), 'r') AND contains(upper(coalesce(cert, '')), 'CE')")
def filter_chain(p):
    return L.filter_chain(p, L.price_between(F.col("price_rmb"), 920, None), L.keyword_filter(F.col("name_zh"), ["r"]), L.cert_filter(F.col("cert"), ["CE"])).select("id")


@query("nl_filter", "products", sql="SELECT id FROM products WHERE price_usd > 115 AND price_usd < 120.5")
def nl_filter(p):
    return p.where(L.nl_predicate("price above 115 and below 120.5", p.columns)).select("id")


@query("sku_leak_filter", "products", sql="SELECT id, sku FROM products WHERE NOT contains(sku, chr(10)) AND NOT instr(sku, ':') BETWEEN 1 AND 15")
def sku_leak_filter(p):
    return p.where(~L.leaks(F.col("sku"))).select("id", "sku")


@query("lookup_by_skus", "products", sql="SELECT sku, min(id) AS id FROM products WHERE user_id = 'u4' AND sku IN (SELECT sku FROM products WHERE id % 3 = 0) GROUP BY sku")
def lookup_by_skus(p):
    return L.lookup_by_skus(p, "u4", p.where("id % 3 = 0")).select("sku", "id")


_FIRST = "row_number() OVER (PARTITION BY sku ORDER BY CASE user_id WHEN 'ev_alls' THEN 0 WHEN 'local' THEN 1 ELSE 2 END, id) = 1"


@query("lookup_by_ids_dedup", "products", sql=f"SELECT id, sku, user_id FROM products WHERE id % 2 = 0 AND NOT contains(sku, chr(10)) AND NOT instr(sku, ':') BETWEEN 1 AND 15 QUALIFY {_FIRST}")
def lookup_by_ids_dedup(p):
    return L.lookup_by_ids(p, ids_of(p, 2)).select("id", "sku", "user_id")


@query("dedup_user_priority", "products", sql=f"SELECT id, sku, user_id FROM products QUALIFY {_FIRST}")
def dedup_user_priority(p):
    return L.first_per_sku(p).select("id", "sku", "user_id")


_ONE = "one AS (SELECT user_id, sku, min(id) AS id, arg_min(price_rmb, id) AS price_rmb FROM products GROUP BY 1, 2)"


@query("order_match", "order_lines", "products", sql=f"{_ONE} SELECT order_id, line_no, trim(o.sku) AS sku, coalesce(TRY_CAST(qty AS INT), 1) AS qty, one.id, count(*) AS n FROM order_lines o LEFT JOIN one ON one.user_id = o.user_id AND one.sku = trim(o.sku) GROUP BY ALL")
def order_match(o, p):
    return L.order_match(o, p).groupBy("order_id", "line_no", "sku", "qty", "id").agg(rows().alias("n"))


@query("order_not_found", "order_lines", "products", sql="SELECT trim(o.sku) AS sku, o.user_id, count(*) AS n FROM order_lines o WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.user_id = o.user_id AND p.sku = trim(o.sku)) GROUP BY 1, 2")
def order_not_found(o, p):
    return L.order_not_found(o, p).groupBy("sku", "user_id").agg(rows().alias("n"))


_UP = ["name_zh", "category", "price_rmb", "price_usd", "moq", "updated_at"]


@query("upsert_products", "products", "incoming", sql="""n AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY user_id, sku ORDER BY id DESC) = 1)
SELECT p.id, p.user_id, p.sku, CASE WHEN n.id IS NULL THEN p.name_zh ELSE n.name_zh END AS name_zh, CASE WHEN n.id IS NULL THEN p.category ELSE n.category END AS category, CASE WHEN n.id IS NULL THEN p.price_rmb ELSE n.price_rmb END AS price_rmb, CASE WHEN n.id IS NULL THEN p.moq ELSE n.moq END AS moq, p.created_at FROM products p LEFT JOIN n ON n.user_id = p.user_id AND n.sku = p.sku
UNION ALL SELECT id, user_id, sku, name_zh, category, price_rmb, moq, NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.user_id = n.user_id AND p.sku = n.sku)""")  # fmt: skip
def upsert_products(p, new):
    return L.upsert(p, new, _UP).select("id", "user_id", "sku", "name_zh", "category", "price_rmb", "moq", "created_at")


@query("upsert_in_place", "products", "incoming", sql="""n AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY user_id, sku ORDER BY id DESC) = 1)
SELECT p.id, p.user_id, p.sku, CASE WHEN n.id IS NULL THEN p.name_zh ELSE n.name_zh END AS name_zh, CASE WHEN n.id IS NULL THEN p.category ELSE n.category END AS category, CASE WHEN n.id IS NULL THEN p.price_rmb ELSE n.price_rmb END AS price_rmb, CASE WHEN n.id IS NULL THEN p.moq ELSE n.moq END AS moq, p.created_at FROM products p LEFT JOIN n ON n.user_id = p.user_id AND n.sku = p.sku
UNION ALL SELECT id, user_id, sku, name_zh, category, price_rmb, moq, NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.user_id = n.user_id AND p.sku = n.sku)""")  # fmt: skip
def upsert_in_place(p, new):
    """The upsert in a stored table, which is read again after it."""
    spark, name = p.sparkSession, f"library_{uuid.uuid4().hex}"
    T.create_library(p, name, shared_folder(spark, "library"), folders=8, buckets=8)
    T.upsert_library(spark, name, new, _UP, folders=8)
    return spark.table(name).select("id", "user_id", "sku", "name_zh", "category", "price_rmb", "moq", "created_at")


@query("patch_products", "products", sql="SELECT id, CASE WHEN id % 6 = 0 THEN round(coalesce(price_rmb * 2, price_rmb) + 1e-9, 4) ELSE round(price_rmb + 1e-9, 4) END AS price_rmb, CASE WHEN id % 12 = 0 THEN 'patched' ELSE category END AS category FROM products")
def patch_products(p):
    changes = p.where("id % 6 = 0").select("id", (F.col("price_rmb") * 2).alias("price_rmb"), F.when(F.col("id") % 12 == 0, "patched").alias("category"))
    return L.patch(p, changes, ["price_rmb", "category"]).select("id", rounded("price_rmb", 4).alias("price_rmb"), "category")


@query("delete_products", "products", sql="SELECT id FROM products WHERE NOT (user_id = 'u2' AND id % 3 = 0)")
def delete_products(p):
    return L.delete(p, ids_of(p, 3), "u2").select("id")


@query("delete_count", "products", sql="SELECT count(*) AS deleted FROM products WHERE user_id = 'u2' AND id % 3 = 0")
def delete_count(p):
    return L.delete_count(p, ids_of(p, 3), "u2")


@query("migrate_missing", "products", sql="SELECT id, user_id, coalesce(price_rmb, CASE WHEN id % 4 <> 0 THEN NULL ELSE 0 END) AS price_rmb FROM products")
def migrate_missing(p):
    target = p.where("id % 4 <> 0").select("id", "user_id", "price_rmb")
    source = p.select(F.col("id").cast("string").alias("id"), "user_id", F.col("price_rmb").cast("string").alias("price_rmb"))
    return L.migrate_missing(target, source, {"price_rmb": 0.0})


@query("unique_sku_suffix", "products_raw", sql="""lib AS (SELECT DISTINCT user_id, model AS sku FROM products_raw WHERE idx % 7 < 2),
b AS (SELECT r.*, row_number() OVER (PARTITION BY r.user_id, model ORDER BY idx) - CASE WHEN lib.sku IS NULL THEN 1 ELSE 0 END AS k FROM products_raw r LEFT JOIN lib ON lib.user_id = r.user_id AND lib.sku = r.model WHERE model <> ''),
m AS (SELECT b.user_id, b.model, unnest(range(max(k) + max(coalesce(l.n, 0)))) AS n FROM b LEFT JOIN (SELECT user_id, count(*) AS n FROM lib GROUP BY 1) l ON l.user_id = b.user_id WHERE k > 0 GROUP BY 1, 2),
f AS (SELECT user_id, model, n, model || '-' || CASE WHEN n >= 26 THEN chr(CAST((n - 26) // 26 + 65 AS INT)) ELSE '' END || chr(CAST(n % 26 + 65 AS INT)) AS name FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, model ORDER BY n) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM lib WHERE lib.user_id = f.user_id AND lib.sku = f.name) AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = f.user_id AND b.model = f.name))
SELECT b.idx, CASE WHEN b.k = 0 THEN b.model ELSE g.name END AS new_sku FROM b LEFT JOIN g ON g.user_id = b.user_id AND g.model = b.model AND g.k = b.k WHERE b.k = 0 OR g.name IS NOT NULL""")  # fmt: skip
def unique_sku_suffix(p):
    library = p.where("idx % 7 < 2").select("user_id", F.col("model").alias("sku")).distinct()
    return L.unique_skus(p, library, "idx").select("idx", "new_sku")


@query("import_products", "products_raw", sql="""SELECT user_id, count(*) FILTER (model <> '') AS imported, count(*) FILTER (coalesce(model, '') = '') AS skipped, count(*) FILTER (price_rmb IS NULL) AS without_price,
  round(sum(CASE WHEN model <> '' THEN round(coalesce(price_rmb, 0) / 7.2 + 1e-9, 2) END) + 1e-9, 2) AS total_usd FROM products_raw GROUP BY user_id""")  # fmt: skip
def import_products(p):
    none = p.limit(0).select("user_id", F.col("model").alias("sku"))
    done = L.unique_skus(p, none, "idx").withColumn("price_usd", rounded(F.coalesce("price_rmb", F.lit(0.0)) / 7.2, 2))
    imported = done.groupBy("user_id").agg(rows().alias("imported"), rounded(F.sum("price_usd"), 2).alias("total_usd"))
    seen = p.groupBy("user_id").agg(rows().alias("seen"), F.count(F.when(F.col("price_rmb").isNull(), 1)).alias("without_price"))
    return seen.join(imported, "user_id").select("user_id", "imported", (F.col("seen") - F.col("imported")).alias("skipped"), "without_price", "total_usd")


_NAMES = "SELECT idx, user_id, CASE WHEN idx % 9 = 4 THEN ' ' || model || ' ' ELSE model END AS model, CASE idx % 5 WHEN 0 THEN '红色 锂电池 ' || idx WHEN 1 THEN NULL ELSE name_zh END AS name_zh, CASE WHEN idx % 4 = 0 THEN 'own name' WHEN idx % 4 = 1 THEN '' ELSE NULL END AS name_en, CASE WHEN idx % 6 = 0 THEN spec_zh || ';Note:x:y; plain ;Grade: last' ELSE spec_zh END AS spec_zh, price_rmb, CASE WHEN idx % 3 = 0 THEN '12' WHEN idx % 3 = 1 THEN 'many' ELSE '0' END AS moq, CAST(CASE WHEN idx % 8 = 0 THEN 2.5 ELSE NULL END AS DOUBLE) AS cbm, image_path, source_file FROM {0}"
_ENGLISH = "name_zh"
for _old, _new in longest_first(WORDS):
    _ENGLISH = f"replace({_ENGLISH}, '{_old}', '{_new}')"


@query("import_rows", "products_raw", sql=f"""p AS (SELECT * REPLACE (trim(coalesce(model, '')) AS model) FROM ({_NAMES.format('products_raw')}) WHERE trim(coalesce(model, '')) <> ''),
lib AS (SELECT DISTINCT user_id, model AS sku FROM products_raw WHERE idx % 7 < 2),
b AS (SELECT r.*, row_number() OVER (PARTITION BY r.user_id, model ORDER BY idx) - CASE WHEN lib.sku IS NULL THEN 1 ELSE 0 END AS k FROM p r LEFT JOIN lib ON lib.user_id = r.user_id AND lib.sku = r.model),
m AS (SELECT b.user_id, b.model, unnest(range(max(k) + max(coalesce(l.n, 0)))) AS n FROM b LEFT JOIN (SELECT user_id, count(*) AS n FROM lib GROUP BY 1) l ON l.user_id = b.user_id WHERE k > 0 GROUP BY 1, 2),
f AS (SELECT user_id, model, n, model || '-' || CASE WHEN n >= 26 THEN chr(CAST((n - 26) // 26 + 65 AS INT)) ELSE '' END || chr(CAST(n % 26 + 65 AS INT)) AS name FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, model ORDER BY n) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM lib WHERE lib.user_id = f.user_id AND lib.sku = f.name) AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = f.user_id AND b.model = f.name)),
s AS (SELECT b.* EXCLUDE (name_zh), CASE WHEN b.k = 0 THEN b.model ELSE g.name END AS sku, b.name_zh AS given FROM b LEFT JOIN g ON g.user_id = b.user_id AND g.model = b.model AND g.k = b.k),
n AS (SELECT *, coalesce(given, sku) AS name_zh FROM s),
t AS (SELECT idx, string_agg(k || '=' || v, '|' ORDER BY k) AS specs FROM (SELECT idx, k, arg_max(v, i) AS v FROM (
  SELECT idx, i, trim(substr(part, 1, instr(part, ':') - 1)) AS k, trim(substr(part, instr(part, ':') + 1)) AS v FROM (SELECT idx, i, trim(ps[i]) AS part FROM (SELECT idx, string_split(spec_zh, ';') AS ps FROM n), unnest(range(1, len(ps) + 1)) AS u(i)) WHERE contains(part, ':')) GROUP BY idx, k) GROUP BY idx)
SELECT n.idx, user_id, sku, name_zh, CASE WHEN coalesce(name_en, '') = '' THEN {_ENGLISH} ELSE name_en END AS name_en, 'new' AS category, coalesce(price_rmb, 0) AS price_rmb, CASE moq WHEN '12' THEN 12 ELSE 1 END AS moq, coalesce(specs, '') AS specs, image_path, source_file, coalesce(cbm, 0) AS cbm
FROM n LEFT JOIN t ON t.idx = n.idx""")
def import_rows(p):
    """Rows of an import as library rows; their specification map as text in the order of its keys."""
    library = p.where("idx % 7 < 2").select("user_id", F.col("model").alias("sku")).distinct()
    done = I.imported_products(p.sparkSession.sql(_NAMES.format("{p}"), p=p), library, "idx", "new")
    specs = F.array_join(F.transform(F.array_sort(F.map_entries("specs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return done.withColumn("specs", specs).select("idx", "user_id", "sku", "name_zh", "name_en", "category", "price_rmb", "moq", "specs", "image_path", "source_file", "cbm")


_ITEMS = "SELECT id, s AS user_id, CASE WHEN id % 4 <> 1 THEN model END AS model, CASE WHEN id % 8 <> 1 THEN name END AS name_zh, CASE WHEN id % 3 = 0 THEN spec ELSE packaging END AS spec_zh, price AS price_rmb, CASE WHEN id % 5 = 0 THEN 'own size' ELSE '' END AS carton_size, CASE WHEN id % 7 = 0 THEN '9.5' WHEN id % 7 = 1 THEN '0' END AS gross_weight, CAST(id % 2 * 6 AS INT) AS units_per_carton, CASE WHEN id % 2 = 0 THEN 'USD' END AS currency FROM {0}"


@query("save_products_web", "texts", sql=f"""x AS ({_ITEMS.format('texts')}),
k AS (SELECT *, list_transform(list_filter(list_transform(string_split_regex(coalesce(spec_zh, ''), '[;\\n]'), lambda p: trim(p)), lambda p: contains(p, ':')), lambda p: {{'k': lower(trim(substr(p, 1, instr(p, ':') - 1))), 'v': trim(substr(p, instr(p, ':') + 1))}}) AS pairs FROM x)
SELECT id, user_id, CASE WHEN regexp_replace(coalesce(model, ''), '^\\s+|\\s+$', '', 'g') <> '' THEN regexp_replace(model, '^\\s+|\\s+$', '', 'g') WHEN coalesce(name_zh, '') <> '' THEN substr(name_zh, 1, 20) ELSE coalesce(nullif(substr(regexp_replace(coalesce(spec_zh, ''), '^\\s+|\\s+$', '', 'g'), 1, 20), ''), 'Item_' || id) END AS model,
  price_rmb, coalesce(currency, 'RMB') AS currency, CASE WHEN carton_size <> '' THEN carton_size ELSE coalesce({_packed('carton_size')}, '') END AS carton_size,
  CASE WHEN TRY_CAST(gross_weight AS DOUBLE) <> 0 THEN TRY_CAST(gross_weight AS DOUBLE) ELSE coalesce({_NUMBER.format(_packed('gross_weight', usable=_NUMBER.format('p.v') + ' IS NOT NULL'))}, 0) END AS gross_weight,
  coalesce({_NUMBER.format(_packed('net_weight', usable=_NUMBER.format('p.v') + ' IS NOT NULL'))}, 0) AS net_weight, coalesce({_NUMBER.format(_packed('cbm', usable=_NUMBER.format('p.v') + ' IS NOT NULL'))}, 0) AS cbm,
  CASE WHEN units_per_carton <> 0 THEN units_per_carton ELSE coalesce({_WHOLE.format(_packed('units_per_carton', usable=_WHOLE.format('p.v') + ' IS NOT NULL'))}, 0) END AS units_per_carton, coalesce({_packed('packing_type')}, '') AS packing_type FROM k""")  # fmt: skip
def save_products_web(t):
    return I.web_products(t.sparkSession.sql(_ITEMS.format("{t}"), t=t), "id").select("id", "user_id", "model", "price_rmb", "currency", *I.PACKED)


@query("distinct_categories", "products", sql="SELECT DISTINCT category FROM products WHERE user_id = 'u5' AND category <> '' ORDER BY 1")
def distinct_categories(p):
    return L.for_user(p, "u5").where(F.col("category") != "").select("category").distinct().orderBy("category")


@query("product_count", "products", sql="SELECT user_id, count(*) AS n FROM products GROUP BY 1")
def product_count(p):
    return p.groupBy("user_id").agg(rows().alias("n"))


@query("usage_quota", "products", "users", sql="SELECT u.id, u.tier, coalesce(n, 0) AS product_count, u.upload_count, u.tier = 'free' AND (coalesce(n, 0) + 10 > 200 OR u.upload_count + 1 > 20) AS over FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM products GROUP BY 1) p ON p.user_id = u.id")
def usage_quota(p, u):
    n = p.groupBy("user_id").agg(rows().alias("n"))
    count = F.coalesce("n", F.lit(0))
    return u.join(n, F.col("id") == F.col("user_id"), "left").select("id", "tier", count.alias("product_count"), "upload_count", ((F.col("tier") == "free") & ((count + 10 > 200) | (F.col("upload_count") + 1 > 20))).alias("over"))


@query("order_by_source", "products", sql="SELECT id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY created_at, id) AS place FROM products")
def order_by_source(p):
    """Rows by source file and time; the place within the file shows the order."""
    return numbered_within(p.select("id", "source_file", "created_at"), "source_file", "created_at", "id").select("id", "source_file", "place")


@query("newest_first", "products", sql="SELECT id, created_at FROM products WHERE user_id = 'u6' ORDER BY created_at DESC, id LIMIT 25")
def newest_first(p):
    """A page of a user's products; product_count has the total."""
    return L.for_user(p, "u6").orderBy(F.desc("created_at"), "id").limit(25).select("id", "created_at")


@query("csv_export", "products", sql="SELECT id, sku, name_zh, name_en, category, price_rmb, price_usd, moq, '{\"units\":\"' || units_per_carton || '\"}' AS specs FROM products WHERE user_id = 'local' ORDER BY id LIMIT 10000")
def csv_export(p):
    specs = F.to_json(F.create_map(F.lit("units"), F.col("units_per_carton").cast("string")))
    return L.export_rows(p.withColumn("specs", specs), "local", ["id", "sku", "name_zh", "name_en", "category", "price_rmb", "price_usd", "moq", "specs"])


@query("csv_export_file", "products", sql="SELECT id::VARCHAR AS id, sku, name_zh, name_en, category, price_rmb, price_usd, moq, 'img/' || id || '.jpg' AS image_path, source_file FROM products WHERE user_id = 'local' ORDER BY id LIMIT 10000")
def csv_export_file(p):
    """The export's one file, read back from the shared folder. Ids are texts there, and the first ones are the first as texts."""
    folder = shared_folder(p.sparkSession, "export")
    p = p.withColumn("id", F.col("id").cast("string"))
    files.export_csv(p.withColumn("image_path", F.concat(F.lit("img/"), "id", F.lit(".jpg"))), folder, "local")
    kinds = "id string, sku string, name_zh string, name_en string, category string, price_rmb double, price_usd double, moq int, image_path string, source_file string"
    back = p.sparkSession.read.schema(kinds).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.select(*files.EXPORTED).fillna({"category": ""})


@query("grouped_output_files", "products", sql="SELECT CASE WHEN category = '' THEN 'Uncategorized' ELSE category END AS sheet, id, CAST((row_number() OVER (PARTITION BY category ORDER BY sku, id) - 1) // 100 AS BIGINT) AS file_no FROM products")
def grouped_output_files(p):
    """A group's rows in numbered files of 100, read back from the shared folder."""
    folder = shared_folder(p.sparkSession, "groups")
    p = p.select("id", "sku", group_key(F.col("category")).alias("sheet"))
    files.write_csv_files(p, folder, ["id", "sku"], ["sku", "id"], "sheet", rows=100)
    back = p.sparkSession.read.schema("id long, sku string, sheet string, file_no long").option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.select("sheet", "id", "file_no")


@query("select_export_columns", "products", sql="SELECT id, coalesce(nullif(name_zh, ''), '') AS name_zh, '' AS name_en, coalesce(nullif(category, ''), 'none') AS category FROM products")
def select_export_columns(p):
    return L.export_columns(p.select("id", "name_zh", "name_en", "category"), ["name_zh", "category"], ["name_zh", "name_en", "category"], {"category": "none"})


@query("grouped_output", "products", sql="SELECT CASE WHEN category = '' THEN 'Uncategorized' ELSE category END AS sheet, id, row_number() OVER (PARTITION BY category ORDER BY sku, id) AS line FROM products")
def grouped_output(p):
    p = p.select("id", "sku", group_key(F.col("category")).alias("sheet"))
    return numbered_within(p, "sheet", "sku", "id").select("sheet", "id", F.col("place").alias("line"))
