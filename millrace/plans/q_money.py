"""Quotations, currencies, trade terms, price texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as P
from ..functions.prices import rounded
from ..operators import quotes as Q
from .registry import query

_CONTINUED = "CASE {0} "


@query("moq_check", "quote_items", sql="SELECT quote_id, line_no, qty >= moq AS valid, CASE WHEN qty < moq THEN moq END AS suggested_qty FROM quote_items")
def moq_check(q):
    return q.withColumn("c", P.moq_check(F.col("qty"), F.col("moq"))).select("quote_id", "line_no", "c.valid", "c.suggested_qty")


_BEST = """CASE WHEN s >= 20000 THEN 'VIP20' WHEN s >= 10000 THEN 'BULK15' WHEN s >= 5000 THEN 'BULK10' WHEN s >= 1000 THEN 'FIXED100' END"""
_SAVE = """CASE WHEN s >= 20000 THEN s * (20.0::DOUBLE / 100) WHEN s >= 10000 THEN s * (15.0::DOUBLE / 100) WHEN s >= 5000 THEN s * (10.0::DOUBLE / 100) WHEN s >= 1000 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"""
_SUB = "t AS (SELECT quote_id, count(*) AS lines, count(*) FILTER (qty < moq) AS moq_errors, round(sum(CASE WHEN qty >= moq THEN qty * unit_price ELSE 0.0 END) + 1e-9, 2) AS s FROM quote_items GROUP BY 1)"


@query("best_discount", "quote_items", sql=f"{_SUB} SELECT quote_id, s AS amount, {_BEST} AS code, round({_SAVE} + 1e-9, 2) AS savings FROM t")
def best_discount(q):
    t = Q.quote_totals(q).select("quote_id", F.col("subtotal").alias("amount"))
    return t.withColumn("b", Q.best_discount(F.col("amount"))).select("quote_id", "amount", "b.code", rounded("b.savings", 2).alias("savings"))


@query("quote_totals", "quote_items", sql=f"{_SUB} SELECT quote_id, lines, moq_errors, s AS subtotal, {_BEST} AS discount_code, round({_SAVE} + 1e-9, 2) AS discount, round(s - {_SAVE} + 1e-9, 2) AS total FROM t")
def quote_totals(q):
    return Q.quote_totals(q)


@query("tier_price", "quote_items", sql="SELECT quote_id, line_no, CASE WHEN qty BETWEEN 1 AND 9 THEN 100.0::DOUBLE WHEN qty BETWEEN 10 AND 24 THEN 90.0::DOUBLE WHEN qty BETWEEN 25 AND 39 THEN 80.0::DOUBLE WHEN qty >= 45 THEN 70.0::DOUBLE ELSE 100.0::DOUBLE END AS price FROM quote_items")
def tier_price(q):
    return q.select("quote_id", "line_no", Q.tier_price(F.col("qty")).alias("price"))


_RATE = "CASE upper({0}) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in P.RATES.items()) + " ELSE 1.0::DOUBLE END"


@query("fx_convert", "quote_items", sql=f"SELECT quote_id, line_no, round(unit_price * ({_RATE.format(chr(39) + 'EUR' + chr(39))} / {_RATE.format('currency')}) + 1e-9, 2) AS eur, round(unit_price * (1.0::DOUBLE / {_RATE.format(chr(39) + 'CNY' + chr(39))}) + 1e-9, 2) AS unknown_code FROM quote_items")
def fx_convert(q):
    return q.select("quote_id", "line_no", P.fx_convert(F.col("unit_price"), F.col("currency"), F.lit("EUR")).alias("eur"), P.fx_convert(F.col("unit_price"), F.lit("CNY"), F.lit("XXX")).alias("unknown_code"))


@query("quotation_amounts", "quote_items", sql="SELECT quote_id, round(sum(CAST(qty AS DOUBLE) * unit_price) + 1e-9, 2) AS amount, max(line_no) AS last_item FROM quote_items GROUP BY 1")
def quotation_amounts(q):
    return Q.quotation_amounts(q)


@query("pi_totals", "quote_items", sql="SELECT quote_id, sum(qty)::BIGINT AS qty, round(sum(CASE WHEN currency NOT IN ('USD', '') THEN round(unit_price * (1 / 7.2::DOUBLE) + 1e-9, 2) ELSE unit_price END * qty) + 1e-9, 2) AS amount FROM quote_items GROUP BY 1")
def pi_totals(q):
    return Q.pi_totals(q)


@query("packing_totals", "quote_items", sql="""SELECT quote_id, sum(qty)::BIGINT AS qty, nullif(round(sum(nw * qty) + 1e-9, 4), 0) AS nw, nullif(round(sum(gw * qty) + 1e-9, 4), 0) AS gw, nullif(round(sum(cbm * greatest(1, ceil(qty / units_per_carton::DOUBLE))) + 1e-9, 4), 0) AS cbm,
  sum(greatest(1, ceil(qty / units_per_carton::DOUBLE)))::BIGINT AS cartons FROM quote_items GROUP BY 1""")  # fmt: skip
def packing_totals(q):
    return Q.packing_totals(q)


@query("invoice_totals", "quote_items", sql="SELECT quote_id, sum(qty)::BIGINT AS qty, round(sum(round(unit_price * (1 / 7.2::DOUBLE) + 1e-9, 2) * qty) + 1e-9, 2) AS amount FROM quote_items GROUP BY 1")
def invoice_totals(q):
    return Q.invoice_totals(q)


@query("selection_totals", "quote_items", sql="SELECT quote_id, sum(qty)::BIGINT AS qty, round(sum(CASE WHEN currency = 'USD' THEN unit_price * 7.2::DOUBLE ELSE unit_price END * qty) + 1e-9, 2) AS amount, round(sum(nw * qty) + 1e-9, 2) AS nw, round(sum(gw * qty) + 1e-9, 2) AS gw FROM quote_items GROUP BY 1")
def selection_totals(q):
    return Q.selection_totals(q)


@query("target_currency_price", "quote_items", sql="SELECT quote_id, line_no, round(CASE WHEN currency <> 'USD' THEN unit_price / 7.2::DOUBLE ELSE unit_price END + 1e-9, 6) AS usd, round(CASE WHEN currency = 'USD' THEN unit_price * 7.2::DOUBLE ELSE unit_price END + 1e-9, 6) AS cny FROM quote_items")
def target_currency_price(q):
    return q.select("quote_id", "line_no", rounded(P.target_currency_price(F.col("unit_price"), F.col("currency"), "USD"), 6).alias("usd"), rounded(P.target_currency_price(F.col("unit_price"), F.col("currency"), "CNY"), 6).alias("cny"))


_TERM = "CASE line_no % 6 WHEN 0 THEN 'EXW' WHEN 1 THEN 'FOB' WHEN 2 THEN 'CFR' WHEN 3 THEN 'CIF' WHEN 4 THEN 'DAP' ELSE 'DDP' END"
_COSTS = f"""x AS (SELECT *, {_TERM} AS term, unit_price * qty AS goods, CASE WHEN gw > 10 AND cbm > 0.2 THEN greatest(cbm, gw / 500) WHEN cbm > 0.2 THEN cbm ELSE 0.5::DOUBLE * qty END AS vol FROM quote_items),
y AS (SELECT *, CASE WHEN term <> 'EXW' THEN vol * 120 ELSE 0 END AS freight FROM x),
z AS (SELECT *, CASE WHEN term IN ('CIF', 'DAP', 'DDP') THEN (goods + freight) * 0.001::DOUBLE ELSE 0 END AS insurance, CASE WHEN term IN ('DAP', 'DDP') THEN goods * 0.1::DOUBLE ELSE 0 END AS duty, CASE WHEN term <> 'EXW' THEN 200 ELSE 0 END + CASE WHEN term = 'DDP' THEN 500 ELSE 0 END AS other FROM y)"""


def _terms(q):
    names = [F.lit(t) for t in P.TERMS]
    q = q.withColumn("term", F.element_at(F.array(*names), (F.col("line_no") % 6 + 1).cast("int")))
    volume = F.when(F.col("cbm") > 0.2, F.col("cbm")).otherwise(0.0)
    weight = F.when(F.col("gw") > 10, F.col("gw")).otherwise(0.0)
    c = P.trade_term(F.col("unit_price"), F.col("qty"), F.col("term"), weight=weight, cbm=volume)
    return q.withColumns(c)


@query("trade_term_price", "quote_items", sql=f"{_COSTS} SELECT quote_id, line_no, term, round(freight + 1e-9, 4) AS freight, round(insurance + 1e-9, 4) AS insurance, round(duty + 1e-9, 4) AS duty, round(goods + freight + 1e-9, 4) AS fob_price, round(goods + freight + insurance + 1e-9, 4) AS cif_price, round(goods + freight + insurance + duty + 1e-9, 4) AS dap_price, round(goods + freight + insurance + duty + other + 1e-9, 4) AS ddp_price, round(goods + freight + insurance + duty + other + 1e-9, 4) AS total FROM z")
def trade_term_price(q):
    c, r = F.col, lambda x, n: rounded(x, 4).alias(n)
    fob = c("goods") + c("freight")
    return _terms(q).select("quote_id", "line_no", "term", r(c("freight"), "freight"), r(c("insurance"), "insurance"), r(c("duty"), "duty"), r(fob, "fob_price"), r(fob + c("insurance"), "cif_price"), r(fob + c("insurance") + c("duty"), "dap_price"), r(fob + c("insurance") + c("duty") + c("other"), "ddp_price"), r(c("total"), "total"))


@query("trade_term_breakdown", "quote_items", sql="""x AS (SELECT quote_id, line_no, unit_price * qty AS goods, greatest(cbm, gw / 500) * 120 AS freight FROM quote_items)
SELECT quote_id, line_no, 6 AS n_items, round(goods + freight + 200 + (goods + freight) * 0.001::DOUBLE + goods * 0.1::DOUBLE + 500 + 1e-9, 2) AS total FROM x""")  # fmt: skip
def trade_term_breakdown(q):
    q = q.withColumns({"base_price": F.col("unit_price"), "weight": F.col("gw")})
    return Q.term_breakdown(q, "DDP").select("quote_id", "line_no", F.size("items").alias("n_items"), rounded("total", 2).alias("total"))


@query("unit_price_by_term", "quote_items", sql=f"{_COSTS} SELECT quote_id, line_no, term, greatest(qty, moq) AS qty, round((goods + freight + insurance + duty + other) / qty / 7.2::DOUBLE + 1e-9, 4) AS unit_usd FROM z")
def unit_price_by_term(q):
    return _terms(q).select("quote_id", "line_no", "term", F.greatest("qty", "moq").alias("qty"), rounded(F.col("total") / F.col("qty") / 7.2, 4).alias("unit_usd"))


@query("quote_items_join", "quote_items", "products", sql="SELECT quote_id, line_no, p.id, round(coalesce(nullif(p.price_usd, 0), p.price_rmb / 7.2::DOUBLE, 0) + 1e-9, 4) AS price FROM quote_items q JOIN products p ON p.id = q.part_id")
def quote_items_join(q, p):
    price = F.coalesce(F.nullif(F.col("price_usd"), F.lit(0.0)), F.col("price_rmb") / 7.2, F.lit(0.0))
    return q.join(p.select("id", "price_usd", "price_rmb"), F.col("part_id") == F.col("id")).select("quote_id", "line_no", "id", rounded(price, 4).alias("price"))


@query("quote_expand", "quotes", "products", sql="""e AS (SELECT id, user_id, file_name, CAST(json_extract(product_ids, '$') AS BIGINT[]) AS ids FROM quotes)
SELECT e.id, i - 1 AS pos, p.id AS product_id, len(ids) AS model_count, CASE WHEN contains(file_name, 'pi_') THEN 'PI' WHEN contains(file_name, 'packing') THEN 'Packing' WHEN contains(file_name, 'invoice') THEN 'Invoice' ELSE 'Quotation' END AS kind
FROM e, unnest(range(1, len(ids) + 1)) AS u(i) JOIN products p ON p.id = ids[i]""")  # fmt: skip
def quote_expand(q, p):
    ids = F.from_json("product_ids", "array<bigint>")
    kind = F.when(F.col("file_name").contains("pi_"), "PI").when(F.col("file_name").contains("packing"), "Packing").when(F.col("file_name").contains("invoice"), "Invoice").otherwise("Quotation")
    e = q.select("id", F.size(ids).alias("model_count"), kind.alias("kind"), F.posexplode(ids).alias("pos", "product_id"))
    return e.join(p.select(F.col("id").alias("pid")), F.col("product_id") == F.col("pid")).select("id", "pos", "product_id", "model_count", "kind")


_NUMS = r"regexp_extract_all(text, '[\d,]+(?:\.\d+)?')"


@query("extract_numbers", "price_texts", sql=f"SELECT row_id, price, text, list_filter(list_transform({_NUMS}, lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)[1] AS first_number, len(list_filter(list_transform({_NUMS}, lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)) AS n FROM price_texts")
def extract_numbers(t):
    n = P.extract_numbers(F.col("text"))
    return t.select("row_id", "price", "text", F.try_element_at(n, F.lit(1)).alias("first_number"), F.size(n).alias("n"))


@query("detect_currency", "price_texts", sql="SELECT row_id, price, text, CASE WHEN contains(text, '$') OR contains(text, 'USD') THEN 'USD' WHEN contains(text, 'EUR') THEN 'EUR' ELSE 'CNY' END AS currency FROM price_texts")
def detect_currency(t):
    return t.select("row_id", "price", "text", P.detect_currency(F.col("text")).alias("currency"))


@query("clean_price", "price_texts", sql=f"""n AS (SELECT *, list_filter(list_transform({_NUMS}, lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS ns FROM price_texts)
SELECT row_id, price, text, round(CASE WHEN contains(text, '%') AND contains(text, 'off') THEN ns[1] * 0.01::DOUBLE WHEN (contains(text, '-') OR contains(text, '~')) AND len(ns) >= 2 THEN (ns[1] + ns[2]) / 2
  WHEN len(ns) > 0 THEN ns[1] * CASE WHEN regexp_matches(text, '\\dK\\b') THEN 1000 WHEN regexp_matches(text, '\\dW\\b') THEN 10000 ELSE 1 END * CASE WHEN contains(text, '$') OR contains(text, 'USD') THEN 7.2::DOUBLE WHEN contains(text, 'EUR') THEN 7.8::DOUBLE ELSE 1 END END + 1e-9, 4) AS yuan FROM n""")  # fmt: skip
def clean_price(t):
    return t.select("row_id", "price", "text", P.let(P.clean_price(F.col("text")), lambda yuan: rounded(yuan, 4)).alias("yuan"))


def _number(*patterns: str) -> str:
    """The first pattern's number that is there, in SQL."""
    return "TRY_CAST(replace(coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in patterns) + "), ',', '') AS DOUBLE)"


#: The bare number without lookarounds: what follows must be the end or a sign that is none of the units. It agrees with
#: the pattern on the texts of price_texts; a test holds the pattern itself against Python.
_BARE = r"(?:^|[^\d,.])([\d,]+(?:\.\d+)?)\s*(?:$|[^\s\d,.WVKA%a-z])"


@query("price_from_value", "price_texts", sql=f"""n AS (SELECT *, {_number(*P._USD)} AS usd, {_number(*P._CNY)} AS cny, {_number(_BARE)} AS bare FROM price_texts)
SELECT row_id, price AS raw, text, CASE WHEN usd > 0 THEN usd WHEN cny > 0 THEN cny WHEN bare > 0.01 AND bare < 1000000 THEN bare END AS price, CASE WHEN usd > 0 THEN round(usd * 7.2::DOUBLE + 1e-9, 2) WHEN cny > 0 THEN cny WHEN bare > 0.01 AND bare < 1000000 THEN bare END AS price_cny,
  CASE WHEN usd > 0 THEN 'USD' WHEN cny > 0 OR (bare > 0.01 AND bare < 1000000) THEN 'CNY' END AS currency FROM n""")  # fmt: skip
def price_from_value(t):
    return t.select("row_id", "price", "text", P.price_from_value(F.col("text")).alias("v")).select("row_id", "price", "text", "v.price", "v.price_cny", "v.currency").toDF("row_id", "raw", "text", "price", "price_cny", "currency")


_AFTER = " ".join(f"nullif(regexp_extract(CASE WHEN instr(low, '{w}') > 0 THEN substr(s, instr(low, '{w}') + {len(w)}) ELSE '' END, '\\d+(?:\\.\\d+)?'), '')," for w in ("price", "total", "$", "¥", "usd"))


@query("clean_price_text", "price_texts", sql=f"n AS (SELECT *, replace(text, ',', '') AS s, lower(replace(text, ',', '')) AS low FROM price_texts) SELECT row_id, price, text, TRY_CAST(coalesce({_AFTER} nullif(regexp_extract(s, '\\d+(?:\\.\\d+)?'), '')) AS DOUBLE) AS value FROM n")
def clean_price_text(t):
    return t.select("row_id", "price", "text", P.clean_price_text(F.col("text")).alias("value"))


@query("price_from_string", "price_texts", sql="n AS (SELECT *, TRY_CAST(replace(nullif(regexp_extract(text, '[\\d,]+(?:\\.\\d+)?'), ''), ',', '') AS DOUBLE) AS v FROM price_texts) SELECT row_id, price, text, CASE WHEN v > 0 AND v BETWEEN 0.01 AND 999999 THEN v END AS value FROM n")
def price_from_string(t):
    return t.select("row_id", "price", "text", P.price_from_string(F.col("text")).alias("value"))


@query("validate_price", "products", sql="SELECT id, coalesce(price_rmb > 0 AND price_rmb BETWEEN 0.01 AND 999999, false) AS ok FROM products")
def validate_price(p):
    return p.select("id", P.validate_price(F.col("price_rmb")).alias("ok"))


@query("reasonable_price", "candidates", sql="SELECT row_no, coalesce(price_rmb >= 0.01 AND price_rmb < 10000000 AND NOT (price_rmb BETWEEN 2021 AND 2029 AND price_rmb = floor(price_rmb)), false) AS ok FROM candidates")
def reasonable_price(c):
    return c.select("row_no", P.reasonable_price(F.col("price_rmb"), 2024).alias("ok"))


@query("is_price_marker", "price_texts", sql="SELECT row_id, price, text, regexp_matches(lower(text), 'price|exw|fob|cif|rmb|usd') AS marker FROM price_texts")
def is_price_marker(t):
    return t.select("row_id", "price", "text", P.is_price_marker(F.col("text")).alias("marker"))


@query("format_price", "products", sql="""SELECT id, CASE WHEN price_rmb IS NULL THEN '' ELSE '¥' || format('{:,.2f}', price_rmb) END AS cny, CASE WHEN price_rmb IS NULL THEN '' ELSE '¥' || format('{:,.0f}', floor(price_rmb)) END AS jpy FROM products""")
def format_price(p):
    return p.select("id", P.format_price(F.col("price_rmb"), F.lit("CNY")).alias("cny"), P.format_price(F.floor("price_rmb").cast("double"), F.lit("JPY")).alias("jpy"))


@query("fob_price", "products", sql="SELECT id, coalesce(round((price_rmb + 20) / 7.2::DOUBLE + 1e-9, 2), 0) AS fob FROM products")
def fob_price(p):
    return p.select("id", P.fob_price(F.col("price_rmb"), 7.2, 20.0).alias("fob"))


@query("cif_price", "products", sql="SELECT id, coalesce(round((price_rmb + 20) / 7.2::DOUBLE + 15 + (price_rmb + 20) / 7.2::DOUBLE * 0.01::DOUBLE + 1e-9, 2), 0) AS cif FROM products")
def cif_price(p):
    return p.select("id", P.cif_price(F.col("price_rmb"), 7.2, 20.0, 15.0, 0.01).alias("cif"))


@query("price_columns", "products", sql="SELECT id, round(price_rmb + 1e-9, 2) AS price_factory, coalesce(round(price_rmb / 7.2::DOUBLE + 1e-9, 2), 0) AS price_fob, coalesce(round(price_rmb / 7.2::DOUBLE + 10 + price_rmb / 7.2::DOUBLE * 0.001::DOUBLE + 1e-9, 2), 0) AS price_cif FROM products")
def price_columns(p):
    r = F.col("price_rmb")
    return p.select("id", rounded(r, 2).alias("price_factory"), P.fob_price(r, 7.2).alias("price_fob"), P.cif_price(r, 7.2, 0.0, 10.0, 0.001).alias("price_cif"))


@query("convert_price_usd", "products_raw", sql="""f AS (SELECT source_file, avg(CASE WHEN price_rmb < 300 THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS usd FROM (SELECT * FROM products_raw WHERE price_rmb > 0 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY idx) <= 10) GROUP BY 1)
SELECT idx, usd, round(CASE WHEN usd THEN price_rmb ELSE price_rmb / 7.2::DOUBLE END + 1e-9, 4) AS price_usd FROM products_raw JOIN f USING (source_file)""")  # fmt: skip
def convert_price_usd(p):
    from ..operators.quality import already_usd

    flag = already_usd(p, "source_file", "price_rmb", "idx")
    return p.join(flag, "source_file").select("idx", "usd", rounded(F.when(F.col("usd"), F.col("price_rmb")).otherwise(F.col("price_rmb") / 7.2), 4).alias("price_usd"))


_ITEMS = "CASE id % 4 WHEN 0 THEN 'Battery' WHEN 1 THEN 'EV ' || name WHEN 2 THEN 'motor ' || name ELSE name END"


@query("classify_price", "texts", sql=f"""x AS (SELECT id, {_ITEMS} AS item FROM texts)
SELECT id, CASE WHEN regexp_matches(lower(item), 'ev|ckd|unit price|complete vehicle|exw price') THEN 'primary' WHEN regexp_matches(lower(item), 'battery') THEN 'battery' WHEN regexp_matches(lower(item), 'motor') THEN 'motor' ELSE 'unclassified' END AS type FROM x""")  # fmt: skip
def classify_price(t):
    item = F.when(F.col("id") % 4 == 0, "Battery").when(F.col("id") % 4 == 1, F.concat(F.lit("EV "), "name")).when(F.col("id") % 4 == 2, F.concat(F.lit("motor "), "name")).otherwise(F.col("name"))
    return t.select("id", P.classify_price(item, P.EV_PRIMARY, P.EV_SECONDARY)["type"].alias("type"))


_LIST_NAME = "CASE id % 4 WHEN 0 THEN 'Medical list ' WHEN 1 THEN 'new EV ' WHEN 2 THEN '电动车' ELSE 'evening ' END || file_name"


@query("detect_industry", "quotes", sql=f"""x AS (SELECT id, lower({_LIST_NAME}) AS low FROM quotes)
SELECT id, CASE WHEN regexp_matches(low, '\\bev\\b|电动|electric') THEN 'ev' WHEN regexp_matches(low, 'medical|医疗|医药') THEN 'medical' ELSE 'ev' END AS industry, CASE WHEN regexp_matches(low, '\\bev\\b|电动|electric') THEN 'ev' WHEN regexp_matches(low, 'medical|医疗|医药') THEN 'medical' ELSE 'other' END AS or_other FROM x""")  # fmt: skip
def detect_industry(q):
    name = F.expr(_LIST_NAME)
    return q.select("id", P.detect_industry(name).alias("industry"), P.detect_industry(name, "other").alias("or_other"))


@query("resolve_price", "lineitem", sql="""g AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ps, max(l_quantity) AS largest, min(l_quantity) AS smallest, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)[1] AS first, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)[-1] AS last FROM lineitem GROUP BY 1),
u AS (SELECT id, p, count(*) AS n, min(i) AS place FROM g, unnest(range(1, len(ps) + 1)) AS t(i), LATERAL (SELECT ps[i] AS p) GROUP BY 1, 2)
SELECT g.id, first, last, largest, smallest, m AS most_common FROM g JOIN (SELECT id, arg_max(p, n * 1000 - place) AS m FROM u GROUP BY 1) USING (id)""")  # fmt: skip
def resolve_price(li):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    ps = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l_quantity"])
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(ps.alias("ps"))
    return g.select("id", *[P.resolve_price(F.col("ps"), s).alias(s) for s in ("first", "last", "largest", "smallest", "most_common")])


@query("composite_price", "texts", sql="""x AS (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS pos FROM (SELECT id, list_filter(list_transform(string_split(replace(parts, chr(10), '/'), '/'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM texts)),
y AS (SELECT id, pos, regexp_extract(ps[pos], '^([A-Za-z一-鿿]+)\\s*[:\\s]*([A-Z]{3})?\\s*([\\d,]+(?:\\.\\d+)?)', 1) AS name, TRY_CAST(replace(regexp_extract(ps[pos], '^([A-Za-z一-鿿]+)\\s*[:\\s]*([A-Z]{3})?\\s*([\\d,]+(?:\\.\\d+)?)', 3), ',', '') AS DOUBLE) AS price FROM x),
z AS (SELECT *, regexp_matches(lower(name), 'ev|ckd|unit price|complete vehicle|exw price') AS main FROM y WHERE price > 0)
SELECT id, coalesce(arg_min(price, pos) FILTER (main), max(price)) AS primary_price, count(*) FILTER (NOT main) AS others, sum(price) FILTER (NOT main AND contains(lower(name), 'battery')) AS battery, sum(price) FILTER (NOT main AND contains(lower(name), 'charger')) AS charger FROM z GROUP BY id""")  # fmt: skip
def composite_price(t):
    return Q.composite_price(t, "id", "parts")


@query("secondary_prices", "texts", sql="SELECT id, round(price + s * 7.2::DOUBLE + 100 + 50 + 1e-9, 4) AS total FROM texts")
def secondary_prices(t):
    part = lambda amount, code: F.struct(amount.cast("double").alias("amount"), F.lit(code).alias("currency"))
    prices = F.create_map(F.lit("battery"), F.array(part(F.col("s"), "USD"), part(F.lit(100), "CNY")), F.lit("charger"), F.array(part(F.lit(50), "CNY")))
    return t.select("id", rounded(Q.secondary_prices(F.col("price"), prices), 4).alias("total"))
