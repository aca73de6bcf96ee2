"""Sheet cells to product rows. A sheet is a long table (file, sheet, row_no, col_no, value); windows are by sheet."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import count_cjk, is_valid_model
from ..functions.prices import blank, clean_price_text
from .header_words import DOCUMENT_LINES, HEAD_ROLES, HEADER_PARTS, HEADER_WORDS, LABELS, NON_PRODUCT, ORDER_NUMBER, PACKAGING_CONTENT, PACKAGING_WORDS, PRICE_WORDS, ROLES, SKIP_WORDS, SKIPPED, SKIPPED_COLUMNS, STRONG_MODEL, STRONG_SPEC

SHEET = ["file", "sheet"]
C = F.col
#: Words by which a layout is told.
PRICE_HEADS = ("price", "单价", "价格", "fob", "exw", "报价")


def any_of(text: Column, words) -> Column:
    """Whether text holds one of the words; one pattern, as hundreds of comparisons make a plan that is slow to compile."""
    return text.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def column_kind(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(any_of(low, ["price", "价格", "单价"]), "price").when(any_of(low, ["spec", "规格", "参数"]), "spec").when(any_of(low, ["name", "名称", "品名"]), "name").when(any_of(low, ["model", "型号"]), "model")


def is_non_product(model: Column, name: Column, spec: Column, most_chinese: int = 20) -> Column:
    m = blank(model)
    both = F.concat_ws(" ", *(F.nullif(blank(c), F.lit("")) for c in (model, name, spec)))
    plain = F.translate(both, " ", " ")
    long_text = ~(m.rlike("[A-Za-z0-9]") & (F.length(m) >= 2)) & (count_cjk(both) > most_chinese) & (F.length(both) > 12)
    return (both == "") | matches(F.translate(m, " ", " "), NON_PRODUCT) | matches(F.lower(plain), NON_PRODUCT) | long_text


def is_product_row(first: Column, qty: Column, price: Column) -> Column:
    """Documents' lines are none; a code of letters and digits is one unless it is an order number; so is a line with a
    price or a quantity; of others those with brackets or a name in title case, without skip words."""
    f = F.coalesce(first, F.lit(""))
    low = F.lower(f)
    code = f.rlike(r"[A-Za-z]+\d+") & (F.length(f) < 40)
    number = F.try_element_at(F.regexp_extract_all(F.coalesce(qty, F.lit("")), F.lit(r"\d+"), F.lit(0)), F.lit(1)).try_cast("long")
    skip = any_of(low, SKIP_WORDS) | (f.rlike(r"^\d+") & any_of(low, ["以下", "以上", "包邮", "执行"]))
    shape = (f.rlike(r"[（(][^）)]*[)）]") & (F.length(f) < 60)) | f.rlike(r"[A-Za-z]+[\d\-/]+") | f.rlike(r"[A-Z][a-z]+\s[A-Z][a-z]+")
    return (
        F.when((f == "") | (F.length(f) > 200) | matches(blank(low), DOCUMENT_LINES), False).when(code, ~f.rlike("(?i)" + ORDER_NUMBER))
        .when(clean_price_text(price) > 0, True).when((number > 0) & (F.length(f) < 100), True).when(skip, False).otherwise(shape)
    )


def wide(cells: DataFrame, columns: dict[int, str]) -> DataFrame:
    """One row per sheet row with named columns; missing cells are empty."""
    return cells.groupBy(*SHEET, "row_no").agg(*[F.coalesce(F.max(F.when(C("col_no") == k, C("value"))), F.lit("")).alias(n) for k, n in columns.items()])


def header_row(cells: DataFrame, first_rows: int = 29) -> DataFrame:
    """Per sheet the row that looks most like a header: the first one below the top with 10 points and 3 cells, else the
    first of the best with 2 points, else the top one. Sheets without cells in those rows have none."""
    value = blank(C("value"))
    low = F.lower(value)
    word = F.when(low.isin(*HEADER_WORDS), 2).when(any_of(low, HEADER_PARTS), 1).otherwise(0)
    price = F.when(any_of(low, PRICE_WORDS), F.when(C("row_no") <= 15, 10).otherwise(3)).otherwise(0)
    r = cells.where(C("row_no").between(1, first_rows) & (value != "")).groupBy(*SHEET, "row_no")
    r = r.agg(F.sum(word + price).alias("points"), F.count(F.lit(1)).alias("cells"), F.sum(F.when(F.length(value) > 30, 3).otherwise(0)).alias("off"))
    r = r.withColumn("score", (C("points") - C("off")) * F.when((C("cells") <= 2) & (C("off") > 0), 0.3).otherwise(1.0))
    sure = F.min(F.when((C("row_no") > 1) & (C("score") >= 10) & (C("cells") >= 3), C("row_no")))
    best = F.max_by("row_no", F.struct("score", -C("row_no")))
    return r.groupBy(*SHEET).agg(F.coalesce(sure, F.when(F.max("score") >= 2, best), F.lit(1)).alias("header"))


def column_facts(cells: DataFrame, headers: DataFrame, most: int = 60) -> DataFrame:
    """Per column up to the 60th: its header in lower case, whether it is a serial number or formulas, how many of the
    next cells look like models, whether a number follows."""
    v = blank(C("value"))
    below = C("row_no") - C("header")
    count = lambda x: F.count(F.when(x, 1))
    full, top = v != "", C("row_no").between(1, 20) & (v != "")
    model = v.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-_\./]+$") & ~v.rlike(r"^\d+$")
    c = cells.where(C("col_no") <= most).join(headers, SHEET).groupBy(*SHEET, "col_no").agg(
        F.max(F.when(below == 0, F.lower(v))).alias("head"), count(top).alias("top"), count(top & v.rlike(r"^\d{1,4}$") & (v.try_cast("int") >= 1)).alias("serials"),
        count(full & below.between(1, 15)).alias("next"), count(below.between(1, 15) & v.startswith("=")).alias("formulas"),
        count(full & below.between(1, 9)).alias("contents"), count(below.between(1, 9) & model).alias("models"), F.coalesce(F.max(below.between(1, 4) & v.try_cast("double").isNotNull()), F.lit(False)).alias("number"),
    )
    serial = (C("top") >= 3) & (C("serials") >= 0.8 * C("top"))
    formula = (C("next") >= 3) & (C("formulas") >= 0.5 * C("next"))
    return c.select(*SHEET, "col_no", F.coalesce("head", F.lit("")).alias("head"), serial.alias("serial"), formula.alias("formula"), "contents", "models", "number")


def header_mapping(cells: DataFrame, headers: DataFrame, roles: dict = ROLES) -> DataFrame:
    """Per sheet the column of each role: columns from the left, each taking the first open role whose words it has.

    Image and serial columns, and those of formulas, have none; a column of serial numbers is neither model nor name; a
    header with a strong word for specifications is no model. Without a name column the model column is it. Without a
    model column it is the one of most cells like models, if those are half; without a price column the first one left
    with a number."""
    c, head = column_facts(cells, headers), C("head")
    hit = {role: any_of(head, words) for role, words in roles.items()}
    hit["model"] = hit["model"] & ~C("serial") & ~(hit["spec"] & any_of(head, STRONG_SPEC) & ~any_of(head, STRONG_MODEL))
    hit["name"] = hit["name"] & ~C("serial")
    usable = (head != "") & ~any_of(head, SKIPPED) & ~C("formula")
    c = c.withColumn("hits", F.array(*[usable & hit[r] for r in roles]))
    heads = c.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("col_no", "hits", "contents", "models", "number"))).alias("heads"))  # 60 columns at most
    start = F.array(*[F.lit(None).cast("int") for _ in roles])

    def step(taken: Column, x: Column) -> Column:
        role = F.array_position(F.transform(taken, lambda c, i: c.isNull() & F.get(x["hits"], i)), True) - 1
        return F.transform(taken, lambda c, i: F.when(i == role, x["col_no"]).otherwise(c))

    heads = heads.withColumn("m", F.aggregate("heads", start, step))
    heads = heads.select(*SHEET, "heads", *[F.get("m", i).alias(role) for i, role in enumerate(roles)])
    alike = F.filter("heads", lambda x: (x["col_no"] <= 30) & (x["contents"] >= 2) & (x["models"] > 0) & (x["models"] >= 0.5 * x["contents"]))
    best = F.array_max(F.transform(alike, lambda x: F.struct(x["models"].alias("n"), (-x["col_no"]).alias("place"))))
    heads = heads.withColumns({"name": F.coalesce("name", "model"), "model": F.coalesce(C("model"), -best["place"])})
    taken = F.array(*[C(r) for r in ("model", "spec", "name", "price", "qty", "packing", "category", "remark") if r in roles])
    numbers = F.filter("heads", lambda x: x["number"] & ~F.coalesce(F.array_contains(F.array_compact(taken), x["col_no"]), F.lit(False)))
    return heads.withColumn("price", F.coalesce(C("price"), F.get(numbers, 0)["col_no"])).select(*SHEET, *roles)


def sheet_currency(cells: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """USD if the price header or one of the next four cells says so, else CNY."""
    near = cells.join(headers, SHEET).join(mapping.select(*SHEET, C("price").alias("price_col")), SHEET).where((C("col_no") == C("price_col")) & C("row_no").between(C("header"), C("header") + 4))
    low = F.lower(F.coalesce("value", F.lit("")))
    says = F.when(C("row_no") == C("header"), any_of(low, ["usd", "$", "fob", "cif", "cfr", "dap", "ddp"])).otherwise(any_of(low, ["$", "usd"]))
    return near.groupBy(*SHEET).agg(F.when(F.max(says), "USD").otherwise("CNY").alias("currency"))


def column_roles(cells: DataFrame, headers: DataFrame, most: int = 59) -> DataFrame:
    """Per column its role, from the header or from up to 59 rows below it, and what these hold: filled cells, serial
    numbers, labels, packaging, models, prices, average length.

    The header's word decides first. Else a column is packaging from 15 % such cells on, skipped if at least 3 and 80 % are
    serial numbers and all are whole, label from 2 and 30 % on, price from 2 and 20 % on if not all are whole, model from 2
    and 15 % on; of others short ones are models, long ones specifications. Columns without contents are skipped."""
    v, below = blank(C("value")), C("row_no") - C("header")
    low = F.lower(v)
    c = cells.join(headers, SHEET).where(below.between(0, most))
    inside = (below > 0) & (v != "")
    n = lambda x: F.count(F.when(inside & x, 1))
    whole = v.rlike(r"^\d+$")
    number = F.regexp_replace(v, r"[¥$€£USDusd,\s]", "").try_cast("double")
    packed = any_of(low, PACKAGING_WORDS).cast("int") + any_of(low, PACKAGING_CONTENT).cast("int")
    g = c.groupBy(*SHEET, "col_no").agg(
        F.coalesce(F.max(F.when(below == 0, low)), F.lit("")).alias("head"), n(F.lit(True)).alias("total"), n(whole & v.try_cast("long").between(1, 999)).alias("serials"), n(low.isin(*LABELS)).alias("labels"),
        F.coalesce(F.sum(F.when(inside, packed)), F.lit(0)).alias("packaging"), n(v.rlike(r"[A-Za-z]+\d+")).alias("models"), n((number > 0.001) & (number < 10_000_000)).alias("prices"), n(~whole).alias("texts"),
        F.coalesce(F.avg(F.when(inside, F.length(v))), F.lit(0.0)).alias("width"),
    )
    tokens = F.split(F.translate("head", "/-()", "    "), r"\s+")
    said = F.lit(None).cast("string")
    for role, words in reversed(HEAD_ROLES.items()):
        short = [w for w in words if len(w.rstrip("$¥() ")) <= 3]
        hit = any_of(C("head"), [w for w in words if w not in short]) | F.arrays_overlap(tokens, F.array(*map(F.lit, short or ["\0"])))
        said = F.when(hit, role).otherwise(said)
    share = lambda x, least, part: C(x) >= F.greatest(F.lit(least), C("total") * part)
    role = (
        F.when(said.isin("skip", "packaging"), said).when(any_of(C("head"), SKIPPED_COLUMNS) | (C("total") == 0), "skip").when(said.isNotNull(), said).when(share("packaging", 1, 0.15), "packaging")
        .when(share("serials", 3, 0.8) & (C("texts") == 0), "skip").when(share("labels", 2, 0.3), "label").when(share("prices", 2, 0.2) & (C("texts") > 0), "price")
        .when(share("models", 2, 0.15), "model").when(C("width") < 25, "model").otherwise("spec")
    )
    return g.select(*SHEET, "col_no", "total", "serials", "labels", "packaging", "models", "prices", role.alias("role"))


def sheet_layout(cells: DataFrame) -> DataFrame:
    """The layout that a sheet's marker cells speak for. A sheet without any, of more than 10 rows and fewer than 6 columns,
    whose first column isn't empty in rows 2 to 11, is one product's specification."""
    v = blank(C("value"))
    low = F.lower(v)
    has = lambda x: F.max(x)
    g = cells.groupBy(*SHEET).agg(
        F.count(F.when((C("col_no") == 1) & low.rlike("[:：]$"), 1)).alias("colons"), has(low.rlike("^model[:：]")).alias("param"), has(any_of(low, ["commercial invoice", "proforma invoice"])).alias("invoice"),
        has((C("row_no") <= 10) & any_of(low, PRICE_HEADS)).alias("price"), F.countDistinct(F.when((C("row_no") <= 3) & low.rlike(r"^[a-z]+-?\d+$"), C("col_no"))).alias("models_across"),
        F.max(F.when(v != "", C("row_no"))).alias("rows"), F.max(F.when(v != "", C("col_no"))).alias("width"), has((C("col_no") == 1) & C("row_no").between(2, 11) & (v != "")).alias("first"),
    )
    single = (C("rows") > 10) & (C("width") < 6) & C("first")
    return g.select(
        *SHEET, F.when(C("colons") >= 4, "kv").when(C("param"), "param_list").when(C("invoice"), "invoice").when(C("price"), "price").when(C("models_across") >= 2, "horizontal").when(single, "single_spec").otherwise("vertical").alias("layout")
    )


def blank_run_cutoff(rows: DataFrame, texts: list[str], run: int = 20, most: int = 2000) -> DataFrame:
    """Rows with something in them up to the first run of blank rows, and at most `most` rows down."""
    full = reduce(or_, (blank(C(t)) != "" for t in texts))
    w = Window.partitionBy(*SHEET).orderBy("row_no")
    r = rows.where(full).withColumn("gap", C("row_no") - F.lag("row_no", 1).over(w) - 1).withColumn("first", F.min("row_no").over(Window.partitionBy(*SHEET)))
    stopped = F.max(F.when(C("gap") >= run, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("stopped", stopped).where((C("stopped") == 0) & (C("row_no") < C("first") + most)).drop("gap", "first", "stopped")


def fill_down(df: DataFrame, partition: list[str], order: str, column: str, out: str) -> DataFrame:
    """Empty values take the last one above; a leading run of empties stays empty."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(F.nullif(C(column), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def fill_merged_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """fill_down by column, for the rows below the header."""
    body = cells.join(headers, SHEET).where(C("row_no") > C("header")).drop("header")
    return fill_down(body, [*SHEET, "col_no"], "row_no", "value", "filled")


def attach_remarks(rows: DataFrame, first: str, texts: list[str]) -> DataFrame:
    """Product rows with the remark and battery or charger rows after them joined to their remark."""
    low = F.lower(C(first))
    remark = any_of(low, ["备注", "remark", "条款", "包装"])
    battery, charger = any_of(low, ["电池", "battery"]), any_of(low, ["充电器", "charger"])
    words = F.concat_ws(" ", *(F.nullif(blank(C(t)), F.lit("")) for t in texts))
    extra = F.when(remark, words).when(battery, F.concat(F.lit("[电池] "), words)).when(charger, F.concat(F.lit("[充电器] "), words))
    w = Window.partitionBy(*SHEET).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("extra", extra).withColumn("product", F.sum(F.when(C("extra").isNull(), 1).otherwise(0)).over(w)).where("product > 0")
    notes = r.groupBy(*SHEET, "product").agg(F.min("row_no").alias("row_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("extra").isNotNull(), F.struct("row_no", "extra")))), lambda x: x["extra"]), " ").alias("remark"))
    return notes.drop("product").join(rows, [*SHEET, "row_no"])


def segment_by_marker(rows: DataFrame, group: list[str], order: str, key: str, value: str, marker: str = "model", price: str = "price", most: int = 50) -> DataFrame:
    """Rows between marker rows as one product: its specifications "k: v" in order, the last price."""
    k = F.lower(blank(C(key)))
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("segment", F.sum(F.when(k == marker, 1).otherwise(0)).over(w)).where("segment > 0")
    is_spec = ~k.isin(marker, price)
    spec = F.array_sort(F.collect_list(F.when(is_spec, F.struct(C(order).alias("o"), F.concat(C(key), F.lit(": "), C(value)).alias("t")))))
    return r.groupBy(*group, "segment").agg(
        F.max(F.when(k == marker, C(value))).alias("model"), F.max_by(C(value), F.when(k == price, C(order))).try_cast("double").alias("price"), F.array_join(F.transform(F.slice(spec, 1, most), lambda x: x["t"]), "; ").alias("spec")
    )


def kv_single_product(rows: DataFrame, group: list[str], order: str, key: str, value: str) -> DataFrame:
    """A key/value sheet as one product: first model, first price, all other rows specifications."""
    k = F.lower(blank(C(key)))
    spec = F.array_sort(F.collect_list(F.when(~k.isin("model", "price"), F.struct(C(order).alias("o"), F.concat(C(key), F.lit(": "), C(value)).alias("t")))))
    return rows.groupBy(*group).agg(F.min_by(C(value), F.when(k == "model", C(order))).alias("model"), F.min_by(C(value), F.when(k == "price", C(order))).try_cast("double").alias("price"), F.array_join(F.transform(spec, lambda x: x["t"]), "; ").alias("spec"))


def aggregate_specs(rows: DataFrame, group: list[str], order: str, spec: str, most: int = 50) -> DataFrame:
    """Per product its specifications, each beginning of 50 characters once, the first `most` in order."""
    first = rows.groupBy(*group, F.substring(spec, 1, 50).alias("head")).agg(F.min(F.struct(C(order).alias("o"), C(spec).alias("t"))).alias("x"))
    return first.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, most), lambda x: x["t"]), "; ").alias("spec"))


def text_blocks(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Blocks of lines between blank ones as products; the last label of a kind counts."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = lines.withColumn("block", F.sum(F.when(blank(C(line)) == "", 1).otherwise(0)).over(w)).where(blank(C(line)) != "")

    def label(words: str) -> Column:
        found = F.nullif(F.regexp_extract(C(line), rf"(?i)^\s*(?:{words})\s*[:：]\s*(.+)$", 1), F.lit(""))
        return F.max_by(found, F.when(found.isNotNull(), C(order)))

    return b.groupBy(doc, "block").agg(F.min(order).alias("first"), label("model|型号").alias("model"), label("price|价格").try_cast("double").alias("price"), label("name|名称").alias("name"), label("spec|规格").alias("spec"), label("qty|数量").alias("qty"))


def suffix_repeated(df: DataFrame, group: str, order: str, model: str) -> DataFrame:
    """Repeated models of a text get -2, -3 …; missing ones OCR-<place>."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    again = F.row_number().over(Window.partitionBy(group, model).orderBy(order))
    m = C(model)
    return df.withColumns({"place": place, "again": again}).withColumn("unique_model", F.when(m.isNull() | (m == ""), F.concat(F.lit("OCR-"), C("place").cast("string"))).when(C("again") > 1, F.concat(m, F.lit("-"), C("again").cast("string"))).otherwise(m)).drop("place", "again")


def horizontal_unpivot(cells: DataFrame, key_col: int, head_row: int) -> DataFrame:
    """Models across the head row, a parameter per row: one product per column with "parameter: value" lines."""
    models = cells.where((C("row_no") == head_row) & (C("col_no") > key_col) & (blank(C("value")) != "")).select(*SHEET, "col_no", blank(C("value")).alias("model"))
    names = cells.where((C("col_no") == key_col) & (C("row_no") > head_row) & (blank(C("value")) != "")).select(*SHEET, "row_no", blank(C("value")).alias("name"))
    body = cells.where((C("row_no") > head_row) & (C("col_no") > key_col) & (blank(C("value")) != ""))
    r = body.join(models, [*SHEET, "col_no"]).join(names, [*SHEET, "row_no"])
    lines = F.array_sort(F.collect_list(F.struct("row_no", F.concat("name", F.lit(": "), blank(C("value"))).alias("t"))))
    return r.groupBy(*SHEET, "col_no", "model").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("spec"))


def vertical_rows(rows: DataFrame) -> DataFrame:
    """Standard table rows with a model (first line, 30 characters) or a price. rows: model, spec, price_text."""
    r = rows.withColumns({"model": F.substring(F.substring_index(blank(C("model")), "\n", 1), 1, 30), "price": clean_price_text(C("price_text"))})
    return r.where((C("model") != "") | C("price").isNotNull())


def invoice_rows(rows: DataFrame) -> DataFrame:
    """Invoice lines: the unit price is total / quantity where it is missing; term lines go. rows: model, qty, unit_price, total."""
    unit = F.coalesce(C("unit_price"), F.try_divide(C("total"), C("qty")))
    return rows.where(~matches(blank(C("model")), NON_PRODUCT)).withColumns({"unit_price": unit, "total": F.coalesce(C("total"), unit * C("qty"))})


def filename_like(model: Column) -> Column:
    return F.lower(F.coalesce(model, F.lit(""))).rlike(r"\.(xlsx?|pdf|docx?|csv)$|^(产品_r\d+|item_\d+)$")


def single_row_filter(df: DataFrame, file: str) -> DataFrame:
    """Files with one product whose model looks like a file name or placeholder yield none."""
    n = df.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.max(filename_like(C("model"))).alias("odd")).where("n = 1 and odd").select(file)
    return df.join(n, file, "left_anti")


def normalize_frame(df: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Standard columns found by keywords in the column names; rows without model and name and header-like rows go."""
    chosen = {}
    for target, words in keywords.items():
        chosen[target] = next((c for c in df.columns for w in words if w.lower() in c.lower()), None)
    d = df.select(*[(C(f"`{c}`") if c else F.lit(None).cast("string")).alias(t) for t, c in chosen.items()])
    heads = [w.lower() for ws in keywords.values() for w in ws]
    return d.where(~((blank(C("model")) == "") & (blank(C("name")) == "")) & ~F.lower(blank(C("model"))).isin(heads))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames stacked in order, columns united; frame_no keeps the order."""
    numbered = [f.withColumn("frame_no", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def cross_table_price(products: DataFrame, cells: DataFrame) -> DataFrame:
    """In tables without any price the i-th product gets the first number of column i of a later table's cells."""
    none = products.groupBy("file").agg(F.count("price").alias("n")).where("n = 0").select("file")
    number = F.replace(F.nullif(F.regexp_extract(C("value"), r"[\d,]+(?:\.\d+)?", 0), F.lit("")), F.lit(",")).try_cast("double")
    found = cells.withColumn("number", number).where("number > 0").groupBy("file", "col_no").agg(F.min_by("number", "row_no").alias("number"))
    p = products.join(none, "file", "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("row_no")))
    return p.join(found, (p["file"] == found["file"]) & (C("i") == C("col_no"))).select(p["file"], "row_no", C("number").alias("price"))
