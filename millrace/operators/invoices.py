"""Invoice sheets to product rows, from the cells."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import blank, cell_price, let
from .grid import SHEET, any_of

C = F.col
#: Words of lines that are no goods, and terms by which a price column is in dollars.
NO_GOODS = (
    "bank", "notice", "term", "delivery", "port", "transship", "handling", "seller", "signed", "payment", "contact", "fax", "to:", "description", "xuzhou", "add:", "e-mail", "email",
    "attn", "reference", "ref:", "date:", "validity", "pi:", "invoice", "proforma",
)
DOLLARS = ("usd", "$", "fob", "cif", "cfr", "dap", "ddp")
#: Columns where the header names none.
DESCRIPTION, SPEC, QTY, PRICE, TOTAL = 1, 3, 4, 5, 6
#: The columns that a header is looked for in, and that are read.
WIDTH = 9
#: The row behind which callers who name none have sheets read no further, as the reference has it.
LAST_ROW = 199


def holds(text: Column, *words: str) -> Column:
    """As any_of, by comparing, which is faster for a few words."""
    return reduce(or_, [text.contains(w) for w in words])


def invoice_grid(cells: DataFrame) -> DataFrame:
    """One row per sheet row: its first nine cells c1 to c9, whether it goes beyond the fifth column (wide) and whether its
    first cell says that the sheet is an invoice (says, in the first 19 rows). The cells are dealt by sheet, once; all that
    follows finds its rows together and in order. Of the other cells only the place counts, so that few of them go along."""
    own = cells.where("file is not null and sheet is not null").where(((C("value") != "") & (C("col_no") <= WIDTH)) | (C("col_no") > 5))
    says = (C("col_no") == DESCRIPTION) & (C("row_no") <= 19) & holds(F.lower("value"), "proforma", "invoice", "description")
    at = [F.max(F.when(C("col_no") == k, C("value"))).alias(f"c{k}") for k in range(1, WIDTH + 1)]
    rows = own.repartition(*SHEET).groupBy(*SHEET, "row_no").agg(*at, F.max(C("col_no") > 5).alias("wide"), F.max(says).alias("says"))
    return rows.withColumns({f"c{k}": F.nullif(f"c{k}", F.lit("")) for k in range(1, WIDTH + 1)})


def invoice_lines(cells: DataFrame, last_row: int | None = None) -> DataFrame:
    """One row per row of an invoice sheet that begins with something, below the header and down to last_row if there is one:
    the sheet's currency, the row's description, specification, quantity, price, total.

    A sheet is an invoice if a first cell of its first 19 rows says so or it has more than 5 columns. The header is the
    first of 24 rows whose first cell speaks of a description or an item, else row 3 if it begins with something, else 1.
    It names the columns of quantity, unit price and total, the last one each, and the currency."""
    first, named = C("c1").isNotNull() & (C("row_no") <= 24), C("named")
    third = first & (C("row_no") == 3)
    r = invoice_grid(cells).withColumn("named", first & holds(F.lower("c1"), "description", "item")).withColumn("head", F.when(named | third | (C("row_no") == 1), header_columns(F.array(*[C(f"c{k}") for k in range(1, WIDTH + 1)]))))
    of = lambda hit: F.min(F.when(hit, F.struct("row_no", "head"))).over(Window.partitionBy(*SHEET))
    ever = lambda name: F.max(name).over(Window.partitionBy(*SHEET))
    r = r.withColumns({"at": F.coalesce(of(named), of(third), of(C("row_no") == 1)), "wide": ever("wide"), "says": ever("says"), "text": blank(C("c1"))})
    r = r.where((C("says") | C("wide")) & (C("text") != "") & (C("row_no") > F.coalesce("at.row_no", F.lit(1))))
    r = r if last_row is None else r.where(C("row_no") <= last_row)
    col = lambda name, default: F.coalesce(F.when(C("wide"), C(f"at.head.{name}")), F.lit(default))
    r = r.withColumns({"qty_col": col("qty", QTY), "price_col": col("price", PRICE), "total_col": col("total", TOTAL)})
    at = lambda name: F.coalesce(*[F.when(C(name) == k, C(f"c{k}")) for k in range(1, WIDTH + 1)])
    return r.select(*SHEET, "row_no", F.when(C("at.head.dollars"), "USD").otherwise("RMB").alias("currency"), "text", C(f"c{SPEC}").alias("spec"), at("qty_col").alias("qty"), at("price_col").alias("price"), at("total_col").alias("total"))


def header_columns(cells: Column) -> Column:
    """What the first nine cells of a header name: the last column of quantity, unit price and total each, and whether prices
    are in dollars."""

    def kind(cell: Column) -> Column:
        low = F.lower(cell)
        return F.when(any_of(low, ("quantity", "qty")), "qty").when(low.contains("unit") & low.contains("price"), "price").when(low.contains("total") & low.contains("amount"), "total").otherwise("")

    last = lambda kinds, name: F.nullif(WIDTH + 1 - F.array_position(F.reverse(kinds), name), F.lit(WIDTH + 1)).cast("int").alias(name)
    return let(F.transform(cells, kind), lambda kinds: F.struct(*[last(kinds, name) for name in ("qty", "price", "total")], any_of(F.lower(cells[PRICE - 1]), DOLLARS).alias("dollars")))


def model_and_name(text: Column) -> tuple[Column, Column]:
    """The first word as model and the rest as name, unless the text begins with a digit; without a space one text for both."""
    split = text.contains(" ") & ~text.rlike(r"^\d")
    model = F.when(split, F.substring(F.regexp_extract(text, r"^\S+", 0), 1, 20)).when(F.length(text) > 25, F.substring(text, 1, 20)).otherwise(text)
    return model, F.substring(F.when(split, F.regexp_extract(text, r"(?s)^\S+\s+(.*)$", 1)).otherwise(text), 1, 50)


def invoice_sheet_rows(cells: DataFrame, last_row: int | None = LAST_ROW) -> DataFrame:
    """Goods of invoice sheets: file, sheet, row_no, model, name, spec, currency, qty, unit_price, total.

    Clauses ("1. …"), totals and lines with a word of NO_GOODS are left out, and so is all behind the first row without a
    description that follows two goods. A missing unit price is total / quantity. last_row: None reads whole sheets, as the
    query does.
    """
    model, name = model_and_name(C("text"))
    low = F.lower("text")
    r = invoice_lines(cells, last_row).withColumns({"model": model, "name": name})
    goods = (F.length("model") >= 2) & ~C("text").rlike(r"^\d+\.\s") & ~any_of(low, ("total", "amount", *NO_GOODS))
    w = Window.partitionBy(*SHEET)
    down = w.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    # rows without a gap between them have the same run; what has another one than the second of the goods is behind a gap
    r = r.withColumn("goods", goods).withColumns({"run": C("row_no") - F.count(F.lit(1)).over(down), "so_far": F.sum(C("goods").cast("int")).over(down)})
    r = r.withColumn("ended", F.coalesce(C("run") > F.min(F.when(C("so_far") >= 2, C("run"))).over(w), F.lit(False))).where("goods and not ended")
    number = F.replace("qty", F.lit(",")).try_cast("double")
    qty = F.when(~F.isnan("number"), F.when(C("number") < 0, F.ceil("number")).otherwise(F.floor("number"))).cast("long")
    price, total = cell_price(C("price")), cell_price(C("total"))
    r = r.withColumn("number", number).withColumns({"qty": qty, "total": total, "unit_price": price})
    unit = F.when((F.coalesce("unit_price", F.lit(0.0)) == 0) & (C("total") != 0) & (C("qty") > 0), C("total") / C("qty")).otherwise(C("unit_price"))
    return r.select(*SHEET, "row_no", "model", "name", F.substring(blank(C("spec")), 1, 500).alias("spec"), "currency", "qty", unit.alias("unit_price"), "total")
