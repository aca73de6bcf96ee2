"""Parsed rows as products of the library and of the web shop: defaults, specification map, packaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import WORDS, translated
from ..functions.models import web_model
from ..functions.prices import blank
from ..functions.specs import packaging_fields
from .library import unique_skus

C = F.col
#: A product's packaging and its default.
PACKED = {"carton_size": "", "gross_weight": 0.0, "net_weight": 0.0, "cbm": 0.0, "units_per_carton": 0, "packing_type": ""}
KINDS = {str: "string", float: "double", int: "int"}


def or_default(df: DataFrame, name: str, default) -> Column:
    """df's column of that name in the default's type; the default where it is missing, null, unreadable, empty or 0."""
    if name not in df.columns:
        return F.lit(default)
    value = C(f"`{name}`").try_cast(KINDS[type(default)])
    return F.coalesce(F.when(value != F.lit(0 if default == 0 else ""), value), F.lit(default))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the columns, of those that there are, that isn't null or empty; else empty."""
    return F.coalesce(*[F.nullif(C(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns], F.lit(""))


def spec_map(spec: Column) -> Column:
    """"key: value" parts between semicolons as a map; of a key's values the last counts, parts without a colon go."""
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ";"), blank), lambda p: p.contains(":"))

    def pair(p: Column) -> Column:
        at = F.when(p.contains(": "), F.instr(p, ": ")).otherwise(F.instr(p, ":"))
        return F.struct(blank(F.substring(p, F.lit(1), at - 1)).alias("k"), blank(F.substring(p, at + 1, F.length(p))).alias("v"))

    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def imported_products(rows: DataFrame, library: DataFrame, order: str, category: str = "", words: dict[str, str] = WORDS) -> DataFrame:
    """Rows with a model as library rows: user_id, sku (free in the library, see unique_skus), names (the English one
    translated where there is none), category, price_rmb, moq, specs (a map), image_path, source_file and packaging.

    A price that is missing or unreadable is 0, a quantity 1. Rows without a model are skipped.
    """
    d = unique_skus(rows.withColumn("model", blank(C("model"))), library, order)
    name = C("name_zh") if "name_zh" in rows.columns else C("spec_zh")
    d = d.withColumn("name_zh", F.coalesce(name, C("new_sku")))
    english = first_of(rows, "name_en")
    d = d.withColumn("__zh", translated(C("name_zh"), words))
    return d.select(
        order, "user_id", C("new_sku").alias("sku"), "name_zh", F.coalesce(F.nullif(english, F.lit("")), "__zh").alias("name_en"), F.lit(category).alias("category"), or_default(rows, "price_rmb", 0.0).alias("price_rmb"),
        F.coalesce(F.nullif(or_default(rows, "moq", 0), F.lit(0)), F.lit(1)).alias("moq"), spec_map(C("spec_zh")).alias("specs"), first_of(rows, "_image_path", "image_path").alias("image_path"),
        first_of(rows, "_source_file", "_source", "source_file").alias("source_file"), *[or_default(rows, n, v).alias(n) for n, v in PACKED.items()],
    )


def web_products(items: DataFrame, row: str) -> DataFrame:
    """Items as rows of the shop: a model of their own, from the name, the specification or the row's number; packaging from
    the item's own columns, else from its specification."""
    d = items.withColumn("__packed", packaging_fields(C("spec_zh")))

    def packed(name: str, default) -> Column:
        own = or_default(items, name, default)
        return F.when(own != F.lit(default), own).otherwise(C(f"__packed.{name}")).alias(name)

    return d.select(
        row, "user_id", web_model(C("model"), C("name_zh"), C("spec_zh"), C(row)).alias("model"), F.coalesce("name_zh", F.lit("")).alias("name_zh"), F.coalesce("spec_zh", F.lit("")).alias("spec_zh"), "price_rmb",
        F.coalesce(C("price_cny") if "price_cny" in items.columns else F.lit(None).cast("double"), F.lit(0.0)).alias("price_cny"), first_of(items, "_image_path").alias("image_path"),
        F.coalesce(C("currency") if "currency" in items.columns else F.lit(None).cast("string"), F.lit("RMB")).alias("currency"), *[packed(n, v) for n, v in PACKED.items()],
    )
