"""Merged ranges of sheets: which cells show another cell's value."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import SHEET

C = F.col
#: A range's rows are cut into tiles of 1, FAN, FAN^2 … rows, each tile as large as fits; sheets have fewer than FAN^LEVELS rows.
FAN, LEVELS = 64, 4


def tile(level: Column, number: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), number.cast("long").alias("tile"))


def cover(first: Column, last: Column) -> Column:
    """Tiles that hold the rows from first to last, each row once: at most 2 * FAN on each level, whatever the range's height."""
    a, b, out = first.cast("long"), last.cast("long") + 1, []
    open_ = a < b
    between = lambda x, y: F.when(y > x, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    for level in range(LEVELS):
        up, down = F.ceil(a / FAN) * FAN, F.floor(b / FAN) * FAN
        higher = (up < down) & F.lit(level < LEVELS - 1)
        numbers = F.when(open_ & higher, F.concat(between(a, up), between(down, b))).when(open_, between(a, b))
        out.append(F.transform(F.coalesce(numbers, F.array().cast("array<bigint>")), partial(tile, F.lit(level))))
        a, b, open_ = F.floor(up / FAN), F.floor(down / FAN), open_ & higher
    return F.concat(*out)


def tiles_of(row: Column) -> Column:
    """The tile of each level that a row lies in."""
    return F.array(*[tile(F.lit(level), F.floor(row / FAN**level)) for level in range(LEVELS)])


def merged_values(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells with a value of their own or, where they have none, that of the first cell of the last range that holds them.

    cells: file, sheet, row_no, col_no, value (null and empty: none); ranges: file, sheet, range_no, row_from, col_from,
    row_to, col_to. A range's value spreads only into rows that hold something themselves. A range whose first cell is
    empty shows nothing, not even a former range's value. Rows find their ranges by equal tiles, so a tall range is
    a few hundred rows of a hash join and rows of a long sheet spread over many tasks.
    """
    full = cells.where(C("value") != "")
    top = full.select(*SHEET, C("row_no").alias("row_from"), C("col_no").alias("col_from"), "value").groupBy(*SHEET, "row_from", "col_from").agg(F.max("value").alias("value"))
    spread = ranges.join(top, [*SHEET, "row_from", "col_from"], "left").withColumn("at", F.explode(cover(C("row_from"), C("row_to"))))
    rows = full.select(*SHEET, "row_no").distinct().withColumn("at", F.explode(tiles_of(C("row_no"))))
    found = rows.join(spread, [*SHEET, "at"])
    shown = found.select(*SHEET, "row_no", F.explode(F.sequence("col_from", "col_to")).alias("col_no"), F.struct("range_no", "value").alias("shown"), F.lit(None).cast("string").alias("own"))
    none = F.lit(None).cast(shown.schema["shown"].dataType)
    every = shown.unionByName(full.select(*SHEET, "row_no", C("col_no").cast(shown.schema["col_no"].dataType).alias("col_no"), none.alias("shown"), C("value").alias("own")))
    out = every.groupBy(*SHEET, "row_no", "col_no").agg(F.coalesce(F.max("own"), F.max("shown")["value"]).alias("value"))
    return out.where(C("value").isNotNull())
