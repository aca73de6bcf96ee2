"""Standard tables of sheets, an article a row, to product rows, from the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import score_row
from ..functions.prices import blank, cell_price
from .grid import SHEET, any_of, header_mapping

C = F.col
#: Words by which the first row is the header, and by which a lower one is.
TOP_HEADER = ("model", "型号", "price", "价格", "spec", "规格", "description")
DEEP_HEADER = ("model", "型号", "price", "金额", "价格", "数量")
#: Marks before a packing and a quantity in the specification; the least score of a product.
PACKING_MARK, QTY_MARK = "[包规] ", "[起订量/数量] "
LEAST_SCORE = -1.5
#: Rows that are searched for a header, for the table's end, and read at most; rows of a footer.
HEADER_ROWS, END_ROWS, MOST_ROWS, FOOTER_ROWS = 34, 199, 2000, 30


def table_bounds(cells: DataFrame) -> DataFrame:
    """Per sheet: header row, the row that ends the table (it isn't part of it) and the last row.

    The first row is the header if it speaks of models, prices or specifications; else the first of rows 2 to 34 that does,
    and the table ends at the first row that begins with a total; else the first row again."""
    full, low = C("value") != "", F.lower(C("value"))
    near = full & (C("col_no") < 10)
    s = cells.groupBy(*SHEET).agg(
        F.max(near & (C("row_no") == 1) & any_of(low, TOP_HEADER)).alias("top"), F.min(F.when(near & C("row_no").between(2, HEADER_ROWS) & any_of(low, DEEP_HEADER), C("row_no"))).alias("deep"), F.max(F.when(full, C("row_no"))).alias("last")
    )
    s = s.withColumn("header", F.when(C("top"), 1).otherwise(F.coalesce("deep", F.lit(1)))).where("last is not null")
    total = cells.where(full & (C("col_no") == 1) & low.contains("total") & (C("row_no") <= END_ROWS)).join(s.where("header > 1").select(*SHEET, "header"), SHEET).where(C("row_no") > C("header"))
    ends = total.groupBy(*SHEET).agg(F.min("row_no").alias("total"))
    s = s.join(ends, SHEET, "left")
    return s.select(*SHEET, "header", F.coalesce("total", F.least(C("last") + 1, F.lit(MOST_ROWS))).alias("end"), "last")


def table_rows(cells: DataFrame, year: int) -> DataFrame:
    """Products of standard tables: file, sheet, row_no, model, name, spec, price, remark.

    Columns are those of the header's words, else the second for the model, the third for the name and the fourth for the
    specification, to which packing and quantity are added. Rows with neither a model of two signs nor a price go, and so
    do those that score below -1.5. A model ends at its line and has 30 signs at most. Lines below the table's end, 30 rows
    at most, are the remark of products without one.
    """
    bounds = table_bounds(cells)
    roles = header_mapping(cells, bounds.select(*SHEET, "header")).select(*SHEET, "model", "name", "spec", "price", "remark", "packing", "qty")
    place = bounds.join(roles, SHEET, "left").select(
        *SHEET, "header", "end", "last", F.coalesce("model", F.lit(2)).alias("model"), F.coalesce("name", F.lit(3)).alias("name"), F.coalesce("spec", F.lit(4)).alias("spec"), "price", "remark", "packing", "qty"
    )
    own = cells.where(C("value") != "").join(place, SHEET).where(C("row_no") > C("header"))
    of = lambda role: F.max(F.when(C("col_no") == C(role), C("value"))).alias(role)
    r = own.where(C("row_no") < C("end")).groupBy(*SHEET, "row_no").agg(*[of(x) for x in ("model", "name", "spec", "price", "remark", "packing", "qty")])
    below = own.where((C("row_no") >= C("end")) & (C("row_no") < C("end") + FOOTER_ROWS) & (C("end") < C("last")) & (C("col_no") == 1) & (blank(C("value")) != ""))
    footer = below.groupBy(*SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "value"))), lambda x: blank(x["value"])), "\n").alias("footer"))  # 30 rows
    price, model = cell_price(C("price")), blank(C("model"))
    r = r.withColumns({"price": price, "model": model}).where((F.length("model") >= 2) | (C("price") > 0))
    spec = F.concat_ws("\n", C("spec"), F.concat(F.lit(PACKING_MARK), C("packing")), F.concat(F.lit(QTY_MARK), C("qty")))
    first = F.when(F.length("model") >= 2, F.substring(blank(F.substring_index("model", "\n", 1)), 1, 30)).otherwise(C("model"))
    r = r.withColumns({"spec": spec, "model": first}).where(score_row(C("model"), C("price"), C("spec"), year) >= LEAST_SCORE)
    r = r.join(footer, SHEET, "left")
    remark = F.coalesce(F.nullif(blank(C("remark")), F.lit("")), C("footer"), F.lit(""))
    return r.select(*SHEET, "row_no", "model", blank(C("name")).alias("name"), "spec", "price", remark.alias("remark"))
