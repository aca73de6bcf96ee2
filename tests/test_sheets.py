"""Merged ranges and invoice sheets: hand cases and random sheets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import invoices as I
from millrace.operators import merged as R

CELLS = "file string, sheet string, row_no int, col_no int, value string"
RANGES = "file string, sheet string, range_no long, row_from int, col_from int, row_to int, col_to int"


@pytest.mark.parametrize("first, last", [(1, 1), (1, 64), (64, 64), (63, 65), (5, 4), (1, 1_048_576), (100, 4_095), (4_096, 8_191), (70_000, 300_000)])
def test_tiles_hold_each_row_once(spark, first, last):
    tiles = [tuple(t) for t in spark.range(1).select(R.cover(F.lit(first), F.lit(last)).alias("t")).first().t]
    assert len(tiles) <= 2 * R.FAN * R.LEVELS
    rows = sorted((n * R.FAN**level, (n + 1) * R.FAN**level) for level, n in tiles)
    assert not tiles and first > last or rows[0][0] == first and rows[-1][1] == last + 1 and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_merged_values_against_a_loop(spark, seed):
    r = random.Random(seed)
    rows = 150 if seed else 12
    cells = [("f", s, row, col, r.choice(["", "a", "b", None, "c"])) for s in ("s1", "s2") for row in range(1, rows) if r.random() < 0.7 for col in range(1, 7) if r.random() < 0.6]
    ranges = []
    for i in range(40):
        a, b = r.randint(1, rows), r.randint(1, 6)
        ranges.append(("f", r.choice(["s1", "s2", "s3"]), i, a, b, a + r.choice([0, 1, 3, 90]), b + r.choice([0, 0, 1, 4])))
    own = {c[:4]: c[4] for c in cells if c[4]}
    want = dict(own)
    full = {c[:3] for c in own}
    shown = {}
    for f, s, _, a, b, c, d in ranges:
        for row in range(a, c + 1):
            for col in range(b, d + 1):
                shown[f, s, row, col] = own.get((f, s, a, b))
    want.update({k: v for k, v in shown.items() if k not in own and v and k[:3] in full})
    got = R.merged_values(spark.createDataFrame(cells, CELLS), spark.createDataFrame(ranges, RANGES)).collect()
    assert sorted(tuple(x) for x in got) == sorted((*k, v) for k, v in want.items())


def test_no_ranges_and_no_cells(spark):
    cells, ranges = spark.createDataFrame([("f", "s", 1, 1, "a"), (None, "s", 2, 1, "b")], CELLS), spark.createDataFrame([("f", "s", 1, 1, 1, 1, 3)], RANGES)
    assert R.merged_values(cells.limit(0), ranges).count() == 0
    assert sorted((x.file or "", x.col_no, x.value) for x in R.merged_values(cells, ranges.limit(0)).collect()) == [("", 1, "b"), ("f", 1, "a")]


def sheet(spark, rows, file="f"):
    """rows: {row: {column: text}}"""
    return spark.createDataFrame([(file, "s", r, c, v) for r, cols in rows.items() for c, v in cols.items()], CELLS)


def read(spark, rows):
    return [tuple(x)[2:] for x in I.invoice_sheet_rows(sheet(spark, rows)).orderBy("row_no").collect()]


def test_invoice_with_header_names(spark):
    rows = {
        1: {1: "PROFORMA INVOICE"}, 4: {1: "Item / Description", 3: "Spec", 4: "Unit Price", 5: "Qty USD", 6: "TOTAL AMOUNT"},
        5: {1: " SP-100 Bluetooth  Speaker ", 3: " 20W ", 4: "", 5: "1,200.7", 6: "2400"}, 6: {1: "1. Clause", 4: "5"}, 7: {1: "12V lamp", 4: "$10", 5: "many"},
        8: {1: "x"}, 9: {1: "Grand Total", 6: "9"}, 10: {1: "A" * 30, 4: "7", 5: "-2.5", 6: "1-3"}, 12: {1: "after the blank row"},
    }
    assert read(spark, rows) == [
        (5, "SP-100", "Bluetooth  Speaker", "20W", "USD", 1200, 2.0, 2400.0),
        (7, "12V lamp", "12V lamp", "", "USD", None, 72.0, None),
        (10, "A" * 20, "A" * 30, "", "USD", -2, 7.0, 2.0),
    ]


def test_invoice_stops_only_behind_two_goods(spark):
    goods = {c: v for c, v in ((4, "1"), (5, "2"), (6, "2"))}
    rows = {3: {1: "Goods"}, 5: {1: "AB-1", **goods}, 7: {1: "AB-2", **goods}, 8: {1: "AB-3", **goods}, 10: {1: "AB-4", **goods}}
    assert [x[0] for x in read(spark, rows)] == [5, 7, 8]
    rows[6] = {1: "Bank: none", **goods}
    assert [x[0] for x in read(spark, rows)] == [5, 7, 8]
    rows[6] = {1: "AB-5", **goods}
    assert [x[0] for x in read(spark, rows)] == [5, 6, 7, 8]
    assert [x[0] for x in read(spark, {r: v for r, v in rows.items() if r != 7})] == [5, 6]
    assert read(spark, {1: {1: "Price list", 5: "x"}, 2: {1: "AB-1"}}) == []
    assert [x[0] for x in read(spark, {2: {1: "AB-1", 6: "5"}, 199: {1: "AB-2"}, 200: {1: "AB-3"}})] == [2, 199]
    assert read(spark, {1: {1: "invoice"}}) == []


def test_invoices_do_not_mix(spark):
    goods = lambda m: {1: {1: "invoice"}, 2: {1: m, 4: "2", 6: "10"}}
    both = sheet(spark, goods("AB-1"), "a").unionByName(sheet(spark, goods("AB-2"), "b"))
    assert sorted((x.file, x.model, x.unit_price) for x in I.invoice_sheet_rows(both).collect()) == [("a", "AB-1", 5.0), ("b", "AB-2", 5.0)]
    assert I.invoice_sheet_rows(both.limit(0)).count() == 0


def test_the_query_reads_whole_invoice_sheets(spark):
    import duckdb

    from millrace.plans import q_sheets, registry

    def rows(free, last):
        body = {r: {1: "Bank: none" if r % 7 == 0 else f"AB-{r} lamp", 4: "2", 5: "" if r % 3 else "4.5", 6: "10"} for r in range(2, last + 1) if r not in free}
        return {1: {1: "Description of goods", 4: "Qty", 6: "Total amount"}, **body}

    kinds = {"a": rows((), 1500), "b": rows((2, 1100), 1500), "c": rows((3, 205), 230), "d": rows(range(3, 1030), 1040), "e": rows(range(4, 1026), 1030), "f": rows(range(2, 260), 263)}
    cells = sheet(spark, kinds.pop("a"), "a")
    for file, body in kinds.items():
        cells = cells.unionByName(sheet(spark, body, file))
    got = q_sheets.invoice_sheet_rows(cells).toPandas()
    last = got.groupby("file").row_no.max().to_dict()
    assert last == {"a": 1500, "b": 1098, "c": 204, "d": 1040, "e": 3, "f": 263}
    con = duckdb.connect()
    con.register("invoice_cells", cells.toPandas())
    want = con.execute("WITH " + registry._all()["invoice_sheet_rows"][2]).df()
    columns = ["file", "row_no", "model", "name", "spec", "currency", "qty", "unit_price", "total"]
    plain = lambda df: sorted(tuple(None if v != v else v for v in r) for r in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)


def test_column_roles_from_contents_and_heads(spark):
    from millrace.operators import grid as G

    heads = ["Carton", "Model No", "(USD)", "Specifications", "", "", "", "", "", "Photo", ""]
    columns = [
        ["1"] * 5, ["EV1", "EV2", "EV3", "x", "y"], ["1", "2", "3", "4", "5"], ["a"] * 5, [str(i) for i in range(1, 6)], ["$12.5", "8.75", "n/a", "x", "y"],
        ["pcs/box 5", "a" * 30, "b" * 30, "c" * 30, "d" * 30], ["Name", "Photo", "备注", "x", "y"], ["AB12", "CD34", "long text number three", "e", "f"], ["z"] * 5, ["w" * 40] * 5,
    ]
    cells = [("f", "s", 1, c + 1, h) for c, h in enumerate(heads)] + [("f", "s", r + 2, c + 1, v) for c, vs in enumerate(columns) for r, v in enumerate(vs)]
    head = spark.createDataFrame([("f", "s", 1)], "file string, sheet string, header int")
    got = {r.col_no: r.role for r in G.column_roles(spark.createDataFrame(cells, CELLS), head).collect()}
    # "model no" holds "no", by which a column is skipped
    assert [got[c] for c in range(1, 12)] == ["packaging", "skip", "price", "spec", "skip", "price", "packaging", "label", "model", "skip", "spec"]


def test_single_specification_layout(spark):
    from millrace.operators import grid as G

    def layout(rows, cols=2, first=True):
        cells = [("f", "s", r, c, f"v{r}.{c}") for r in range(1, rows + 1) for c in range(1, cols + 1) if c > 1 or first or r == 1]
        return G.sheet_layout(spark.createDataFrame(cells, CELLS)).first().layout

    assert [layout(11), layout(10), layout(11, 5), layout(11, 6), layout(30, 2, False)] == ["single_spec", "vertical", "single_spec", "vertical", "vertical"]


def test_table_under_titles_with_total_and_footer(spark):
    from millrace.operators import tables as T

    rows = {
        1: {1: "Shanghai Factory 2026"}, 4: {1: "No.", 2: "Model", 3: "Product name", 4: "Specification", 5: "Unit price", 6: "Packing", 7: "Remark", 8: "Qty"},
        5: {1: "1", 2: "SP-100\nsecond", 3: " Speaker ", 4: "20W", 5: "89.00", 6: "box", 7: "own", 8: "200"}, 6: {1: "2", 2: "SP-200", 5: "$35"}, 7: {1: "3", 2: "x"}, 8: {1: "4", 5: "12"}, 9: {2: "payment terms"},
        10: {1: "Grand Total", 5: "99"}, 11: {1: " keep dry "}, 13: {1: "pay soon", 2: "LATE-1"},
    }
    got = [tuple(x)[2:] for x in T.table_rows(sheet(spark, rows), 2024).orderBy("row_no").collect()]
    footer = "Grand Total\nkeep dry\npay soon"
    assert got == [(5, "SP-100", "Speaker", "20W\n[包规] box\n[起订量/数量] 200", 89.0, "own"), (6, "SP-200", "", "", 252.0, footer), (8, "", "", "", 12.0, footer), (9, "payment terms", "", "", None, footer)]


def test_table_without_header_words(spark):
    from millrace.operators import tables as T

    rows = {1: {1: "a", 2: "b", 3: "c", 4: "d"}, 2: {1: "1", 2: "AB-1", 3: "lamp", 4: "5W of light and more"}, 1999: {2: "AB-2"}, 2000: {2: "AB-3"}}
    assert [(x.row_no, x.model, x.name, x.spec) for x in T.table_rows(sheet(spark, rows), 2024).orderBy("row_no").collect()] == [(2, "AB-1", "lamp", "5W of light and more"), (1999, "AB-2", "", "")]
    assert T.table_rows(sheet(spark, rows).limit(0), 2024).count() == 0
