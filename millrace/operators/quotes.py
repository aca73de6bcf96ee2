"""Quotations: tiers, discounts, totals, packing, invoices, composite prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prices as P
from ..functions.prices import rounded

#: Fixed discounts: code, kind, value, least order; of equal savings the first counts.
DISCOUNTS = (("BULK10", "percentage", 10.0, 5000.0), ("BULK15", "percentage", 15.0, 10000.0), ("VIP20", "percentage", 20.0, 20000.0), ("FIXED100", "fixed", 100.0, 1000.0))
#: Example tiers: least and greatest quantity (None: open), unit price.
TIERS = ((1, 9, 100.0), (10, 24, 90.0), (25, 39, 80.0), (45, None, 70.0))


def tier_price(qty: Column, tiers=TIERS) -> Column:
    """Price of the first tier by least quantity that takes qty; the lowest tier if none does; 0 without tiers.

    Tiers are a handful of parameters, so they are an expression and no join."""
    ordered = sorted(tiers, key=lambda t: t[0])
    if not ordered:
        return F.lit(0.0)
    out = F.lit(float(ordered[0][2]))
    for low, high, price in reversed(ordered):
        fits = (qty >= low) & (qty <= high) if high is not None else qty >= low
        out = F.when(fits, F.lit(float(price))).otherwise(out)
    return out


def best_discount(amount: Column, discounts=DISCOUNTS) -> Column:
    """(savings, code): greatest saving above 0, the first listed among equals, else (0, null)."""
    best = F.struct(F.lit(0.0).alias("savings"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("code"))
    options = [best]
    for i, (code, kind, value, least) in enumerate(discounts):
        off = amount * (value / 100) if kind == "percentage" else F.least(F.lit(value), amount)
        saved = F.when((amount >= least) & (off > 0), off).otherwise(F.lit(0.0))
        options.append(F.struct(saved.alias("savings"), F.lit(-1 - i).alias("place"), F.lit(code).alias("code")))
    top = F.array_max(F.filter(F.array(*options), lambda o: o["code"].isNull() | (o["savings"] > 0)))
    return F.struct(top["savings"].alias("savings"), top["code"].alias("code"))


def quote_totals(items: DataFrame, discounts=DISCOUNTS) -> DataFrame:
    """Per quote: subtotal of lines that reach their MOQ, best discount, total, number of lines below it."""
    valid = F.col("qty") >= F.col("moq")
    t = items.groupBy("quote_id").agg(
        rounded(F.sum(F.when(valid, F.col("qty") * F.col("unit_price")).otherwise(0.0)), 2).alias("subtotal"), F.count(F.lit(1)).alias("lines"), F.count(F.when(~valid, 1)).alias("moq_errors")
    )
    best = best_discount(F.col("subtotal"), discounts)
    return t.withColumn("best", best).select("quote_id", "lines", "moq_errors", "subtotal", F.col("best.code").alias("discount_code"), rounded("best.savings", 2).alias("discount"), rounded(F.col("subtotal") - F.col("best.savings"), 2).alias("total"))


def pi_totals(items: DataFrame, target: str = "USD", rate: float = 1 / 7.2) -> DataFrame:
    """Proforma invoice: prices in another currency than USD (or none) are taken at the rate."""
    price = F.when((F.col("currency") != "USD") & (F.col("currency") != ""), rounded(F.col("unit_price") * rate, 2)).otherwise(F.col("unit_price")) if target == "USD" else F.col("unit_price")
    return items.groupBy("quote_id").agg(F.sum("qty").alias("qty"), rounded(F.sum(price * F.col("qty")), 2).alias("amount"))


def packing_totals(items: DataFrame) -> DataFrame:
    """Cartons (one at least a line), quantity, weights and volume; totals of 0 are blank."""
    cartons = F.greatest(F.lit(1), F.ceil(F.col("qty") / F.col("units_per_carton")))
    blank = lambda c: F.nullif(rounded(F.sum(c), 4), F.lit(0.0))
    return items.groupBy("quote_id").agg(F.sum("qty").alias("qty"), blank(F.col("nw") * F.col("qty")).alias("nw"), blank(F.col("gw") * F.col("qty")).alias("gw"), blank(F.col("cbm") * cartons).alias("cbm"), F.sum(cartons).alias("cartons"))


def invoice_totals(items: DataFrame, target: str = "USD", rate: float = 1 / 7.2) -> DataFrame:
    """Commercial invoice: every price is taken at the rate."""
    price = rounded(F.col("unit_price") * rate, 2) if target == "USD" else F.col("unit_price")
    return items.groupBy("quote_id").agg(F.sum("qty").alias("qty"), rounded(F.sum(price * F.col("qty")), 2).alias("amount"))


def selection_totals(items: DataFrame, target: str = "CNY", rate: float = 7.2) -> DataFrame:
    price = P.target_currency_price(F.col("unit_price"), F.col("currency"), target, rate)
    s = lambda c, name: rounded(F.sum(c), 2).alias(name)
    return items.groupBy("quote_id").agg(F.sum("qty").alias("qty"), s(price * F.col("qty"), "amount"), s(F.col("nw") * F.col("qty"), "nw"), s(F.col("gw") * F.col("qty"), "gw"))


def quotation_amounts(items: DataFrame) -> DataFrame:
    """Printed quotation: a quantity that isn't a number counts as 0."""
    qty = F.coalesce(F.col("qty").cast("string").try_cast("double"), F.lit(0.0))
    return items.groupBy("quote_id").agg(rounded(F.sum(qty * F.col("unit_price")), 2).alias("amount"), F.max("line_no").alias("last_item"))


def term_breakdown(df: DataFrame, term: str, **costs) -> DataFrame:
    """Cost items of one trade term as an array of (name, amount), and their total."""
    c = P.trade_term(F.col("base_price"), F.col("qty"), F.lit(term), weight=F.col("weight"), cbm=F.col("cbm"), **costs)
    item = lambda name, amount: F.struct(F.lit(name).alias("name"), amount.alias("amount"))
    items = [item("Ex Works Price", c["goods"])]
    if term != "EXW":
        items += [item("Ocean Freight", c["freight"]), item("Export Clearance", F.lit(200.0))]
    if term in ("CIF", "DAP", "DDP"):
        items.append(item("Marine Insurance", c["insurance"]))
    if term in ("DAP", "DDP"):
        items.append(item("Import Duty (est.)", c["duty"]))
    if term == "DDP":
        items.append(item("Delivery Cost", F.lit(500.0)))
    return df.withColumn("items", F.array(*items)).withColumn("total", F.aggregate("items", F.lit(0.0), lambda s, x: s + x["amount"]))


def composite_price(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Parts of "name: CUR 1,000 / name: 500": first primary price, number of others and their sum by class; without a
    primary one the largest."""
    pattern = r"^([A-Za-z一-鿿]+)\s*[:\s]*([A-Z]{3})?\s*([\d,]+(?:\.\d+)?)"
    d = df.select(id_col, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", "/"), "/")).alias("pos", "part")).withColumn("part", P.blank(F.col("part"))).where("part != ''")
    group = lambda i: F.nullif(F.regexp_extract("part", pattern, i), F.lit(""))
    d = d.withColumns({"name": group(1), "currency": F.coalesce(group(2), F.lit("CNY")), "price": F.replace(group(3), F.lit(",")).try_cast("double")})
    d = d.where("price > 0").withColumn("c", P.classify_price(F.col("name"), P.EV_PRIMARY, P.EV_SECONDARY))
    first = F.min_by("price", F.when(F.col("c.is_primary"), F.col("pos")))
    g = d.groupBy(id_col).agg(first.alias("primary"), F.max("price").alias("largest"), F.count(F.when(~F.col("c.is_primary"), 1)).alias("others"), F.sum(F.when(F.col("c.type") == "battery", F.col("price"))).alias("battery"), F.sum(F.when(F.col("c.type") == "charger", F.col("price"))).alias("charger"))
    return g.select(id_col, F.coalesce("primary", "largest").alias("primary_price"), "others", "battery", "charger")


def secondary_prices(base: Column, prices: Column, rates: dict[str, float] = P.YUAN) -> Column:
    """base and all optional parts (map of class to array of (amount, currency)) in yuan."""
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    all_parts = F.flatten(F.map_values(prices))
    return base + F.coalesce(F.aggregate(all_parts, F.lit(0.0), lambda s, p: s + p["amount"] * F.coalesce(F.try_element_at(table, p["currency"]), F.lit(1.0))), F.lit(0.0))
