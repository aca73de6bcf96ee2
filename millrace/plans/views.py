"""Views of the shared tables: product, order, quotation, sheet, image and event data in the shapes that the jobs take.

Each view is one SELECT in the common part of Spark's and DuckDB's SQL; {name} stands for a table or another view.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import staged, staged_in_parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_G = "CAST(floor(p_partkey / 4) AS BIGINT)"
_USER = "CASE p_partkey % 7 WHEN 0 THEN 'ev_alls' WHEN 1 THEN 'local' ELSE 'u' || CAST(p_partkey % 7 AS STRING) END"
_DAY = "'2024-01-' || lpad(CAST(1 + {0} % 28 AS STRING), 2, '0')"

def _cells() -> str:
    """Four columns of each part as cells, fifty parts a sheet, under a title, an order number and a header."""
    file = "'f' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING)"
    values = {
        1: "CASE WHEN p_partkey % 50 = 45 THEN 'Remark: keep dry' WHEN p_partkey % 6 = 2 THEN '' WHEN p_partkey % 50 = 30 THEN 'battery 20AH' ELSE 'EV' || CAST(p_partkey AS STRING) END",
        2: "p_name",
        3: "'Motor ' || CAST(p_size * 100 AS STRING) || 'W'",
        4: "CASE WHEN p_partkey % 8 = 5 THEN '' ELSE CAST(p_retailprice AS STRING) END",
    }
    heads = {
        1: ["'Price list of the best company in the whole wide world'", "''", "''", "''"],
        2: ["'PO-20240101'", "''", "''", "''"],
        3: ["'Model'", "'Product name'", "'Specification'", "CASE WHEN CAST(floor(p_partkey / 50) AS BIGINT) % 2 = 0 THEN 'FOB Price(USD)' ELSE 'Price' END"],
    }
    body = [f"SELECT {file} AS file, 's1' AS sheet, CAST(p_partkey % 50 + 4 AS INT) AS row_no, {c} AS col_no, {v} AS value FROM {{part}} WHERE NOT (p_partkey % 50 BETWEEN 20 AND 22)" for c, v in values.items()]
    body += [f"SELECT {file}, 's1', {r}, {c}, {v} FROM {{part}} WHERE p_partkey % 50 = 0" for r, vs in heads.items() for c, v in enumerate(vs, 1)]
    return " UNION ALL ".join(body)


def _sheets() -> str:
    """Sheets of eight kinds, fifty parts each: three price lists with other columns and orders, name and value, parameter
    list, invoice, models across, plain. Titles, header rows from 2 to 4, and up to 29 blank rows before part 25."""
    f = "CAST(floor(p_partkey / 50) AS BIGINT)"
    head, part = f"(2 + {f} % 3)", "CAST(p_partkey AS STRING)"
    size, price, name = "CAST(p_size AS STRING)", "CAST(p_retailprice AS STRING)", "p_name"
    label = "CASE p_partkey % 5 WHEN 0 THEN 'Motor' WHEN 1 THEN 'Battery' WHEN 2 THEN 'Range' WHEN 3 THEN 'Colour' ELSE 'Brake' END"
    body = (
        (f"'EV' || {part}", name, f"'Motor ' || {size} || 'W'", price, "''"),
        (f"CAST(p_partkey % 50 + 1 AS STRING)", price, f"'AB-' || {part}", size, f"{size} || 'x20'"),
        (name, f"'ZX' || {part}", price, f"'=DISPIMG(' || {part} || ')'", "'1 year'"),
        (f"{label} || ':'", name, "''", "''", "''"),
        (f"CASE WHEN p_partkey % 5 = 0 THEN 'Model: EV' || {part} ELSE {label} END", name, "''", "''", "''"),
        (f"'IT-' || {part}", size, price, "''", "''"),
        (label, name, size, name, "''"),
        (f"'lot ' || {part}", name, "''", "''", "''"),
    )
    heads = (
        ("'Model'", "'Product name'", "'Specification'", f"CASE WHEN {f} % 16 < 8 THEN 'FOB Price(USD)' ELSE 'Unit price RMB' END", "''"),
        ("'No.'", "'Price'", "'Item No.'", "'MOQ'", "'Size'"),
        ("'Product'", "'Code'", "'EXW'", "'View'", "'Warranty'"),
        ("''", "''", "''", "''", "''"),
        ("''", "''", "''", "''", "''"),
        ("'Item No.'", "'Qty'", "'Unit price'", "''", "''"),
        ("'Parameter'", f"'EV-' || CAST({f} AS STRING)", f"'EV' || CAST({f} + 7 AS STRING)", "'other'", "''"),
        ("'a'", "'b'", "''", "''", "''"),
    )
    case = lambda rows, c: f"CASE {f} % 8 " + " ".join(f"WHEN {k} THEN {r[c]}" for k, r in enumerate(rows)) + " END"
    row = f"CAST({head} + 1 + p_partkey % 50 + CASE WHEN p_partkey % 50 >= 25 THEN {f} % 30 ELSE 0 END AS INT)"
    key = f"'f' || CAST({f} AS STRING) AS file, 's1' AS sheet"
    out = [f"SELECT {key}, {row} AS row_no, {c + 1} AS col_no, {case(body, c)} AS value FROM {{part}}" for c in range(5)]
    out += [f"SELECT {key}, CAST({head} AS INT), {c + 1}, {case(heads, c)} FROM {{part}} WHERE p_partkey % 50 = 0" for c in range(5)]
    out.append(f"SELECT {key}, 1, 1, CASE WHEN {f} % 8 = 5 THEN 'COMMERCIAL INVOICE' ELSE 'Offer of the best company in the whole wide world' END FROM {{part}} WHERE p_partkey % 50 = 0")
    return " UNION ALL ".join(out)


def _phrase(number: str) -> str:
    """One of many phrases with words that overlap, hold each other, or stand beside codes."""
    phrases = (
        "红色 锂电池 ABC", "铝合金框锂电池", "CE认证 ABC12", "FOB价格/EXW价格", "千米/小时 最大功率", "磷酸铁锂电池容量大小", "不含电池 有无高中低", "样品费 付款方式交货期", "毫安时千瓦时 mAh", "外形尺寸 长宽高厚",
        "LED2 灯 ISO 9001 证书", "额定电压电流", "产品名称规格参数", "公司名称 联系人", "年月日期 小时", "生产周期有效期", "充电时间度", "ABC价格 ABC", "无刷电机功率", "名称", "最大最小平均", "FOB 价格CE", "塑料 玻璃米克",
    )
    return f"CASE ({number}) % {len(phrases)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(phrases)) + " END"


def _invoice_cells() -> str:
    """Each order an invoice sheet of three kinds: columns as usual, others named by the header, and five columns only.
    Headers in rows 3 to 6, or none; rows left free after the first or the third line; clauses, totals and bank lines."""
    kind, head = "(quote_id % 3)", "(3 + quote_id % 4)"
    row = f"CAST({head} + line_no + CASE WHEN quote_id % 5 = 0 AND line_no > 3 THEN 1 ELSE 0 END + CASE WHEN quote_id % 7 = 1 AND line_no > 1 THEN 2 ELSE 0 END AS INT)"
    text = "CASE (quote_id + line_no) % 11 WHEN 0 THEN '1. Payment within 30 days' WHEN 1 THEN 'Total of goods' WHEN 2 THEN 'Beneficiary Bank' WHEN 3 THEN sku || '  lamp with a name ' || sku || ' that goes on and on, and on' WHEN 4 THEN '12V lamp ' || sku WHEN 5 THEN sku || 'abcdefghijklmnopqrstuvwxyz' WHEN 6 THEN 'x' WHEN 7 THEN ' ' ELSE ' ' || sku END"
    number = "CASE WHEN line_no % 4 = 1 THEN '1,' || lpad(CAST(qty AS STRING), 3, '0') WHEN line_no % 7 = 2 THEN 'about 5' ELSE CAST(qty AS STRING) || '.9' END"
    price = "CASE WHEN line_no % 2 = 0 THEN '' WHEN line_no % 5 = 3 THEN '$' || CAST(qty AS STRING) ELSE CAST(unit_price AS STRING) END"
    total = "CASE WHEN line_no % 6 = 5 THEN '' ELSE CAST(qty * 25 AS STRING) END"
    columns = {1: text, 3: "CASE WHEN line_no % 3 = 0 THEN '' ELSE ' spec of ' || sku || ' ' END", 4: f"CASE {kind} WHEN 1 THEN {price} ELSE {number} END", 5: f"CASE {kind} WHEN 1 THEN {number} ELSE {price} END", 6: f"CASE {kind} WHEN 2 THEN '' ELSE {total} END"}
    key = "'q' || CAST(quote_id AS STRING) AS file, 's1' AS sheet"
    out = [f"SELECT {key}, {row} AS row_no, {c} AS col_no, {v} AS value FROM {{quote_items}} WHERE NOT ({c} = 6 AND {kind} = 2)" for c, v in columns.items()]
    heads = {1: "CASE WHEN quote_id % 8 = 3 THEN 'Goods' ELSE 'Description of goods' END", 3: "'Spec'", 4: f"CASE {kind} WHEN 1 THEN 'Unit Price' ELSE 'Qty' END", 5: f"CASE {kind} WHEN 1 THEN 'Quantity (USD)' WHEN 2 THEN 'FOB price' ELSE 'Price' END", 6: f"CASE {kind} WHEN 1 THEN 'Total Amount' ELSE 'Sum' END"}
    orders = "(SELECT DISTINCT o_orderkey AS quote_id FROM {orders}) AS o"
    out += [f"SELECT {key}, CAST({head} AS INT), {c}, {v} FROM {orders} WHERE NOT ({c} = 6 AND {kind} = 2)" for c, v in heads.items()]
    out.append(f"SELECT {key}, 1, 1, CASE WHEN quote_id % 6 = 5 THEN 'Offer' ELSE 'PROFORMA INVOICE' END FROM {orders}")
    return " UNION ALL ".join(out)


def _table_sheets() -> str:
    """Standard tables of fifty parts: under a header in row 1, under titles with a total and notes below, without a header."""
    f, i = "CAST(floor(p_partkey / 50) AS BIGINT)", "p_partkey % 50"
    head, part = f"CASE {f} % 3 WHEN 1 THEN 4 + {f} % 5 ELSE 1 END", "CAST(p_partkey AS STRING)"
    key = f"'t' || CAST({f} AS STRING) AS file, 's1' AS sheet"
    model = f"CASE p_partkey % 7 WHEN 0 THEN 'EV' || {part} || chr(10) || 'second line' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'payment terms' WHEN 4 THEN 'a name with a lot of words and no number at all' WHEN 5 THEN ' KX-' || {part} || ' ' ELSE 'EV' || {part} END"
    price = f"CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '$' || CAST(p_size AS STRING) ELSE CAST(p_retailprice AS STRING) END"
    first = f"CASE WHEN {i} = 30 THEN 'Sub Total' WHEN {i} > 30 AND {i} % 3 = 0 THEN ' note ' || {part} || ' ' WHEN {i} > 30 THEN ' ' ELSE {part} END"
    columns = {1: first, 2: model, 3: "p_name", 4: "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Motor ' || CAST(p_size AS STRING) || '00W of the best kind' END", 5: price, 6: "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) || ' pcs' END", 7: "CASE WHEN p_partkey % 3 = 0 THEN ' keep dry ' ELSE '' END", 8: "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size AS STRING) END"}
    out = [f"SELECT {key}, CAST({head} + 1 + {i} AS INT) AS row_no, {c} AS col_no, {v} AS value FROM {{part}}" for c, v in columns.items()]
    heads = {1: "No.", 2: "Model", 3: "Product name", 4: "Specification", 5: "Unit Price", 6: "Packing", 7: "Remark", 8: "Qty"}
    out += [f"SELECT {key}, CAST({head} AS INT), {c}, CASE WHEN {f} % 3 = 2 THEN 'v{c}' ELSE '{v}' END FROM {{part}} WHERE {i} = 0" for c, v in heads.items()]
    out.append(f"SELECT {key}, 1, 1, 'Offer' FROM {{part}} WHERE {i} = 0 AND {f} % 3 = 1")
    return " UNION ALL ".join(out)


def _merges() -> str:
    """Merged ranges of the sheets in `cells`: down over empty models, up to a price, wide and overlapping, one cell, tall."""
    file, row = "'f' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS file, 's1' AS sheet", "CAST(p_partkey % 50 + 4 AS INT)"
    kinds = (("p_partkey % 6 = 1", 0, 1, 2, 1), ("p_partkey % 8 = 4", 0, 4, 1, 4), ("p_partkey % 25 = 10", 0, 2, 3, 7), ("p_partkey % 10 = 3", -1, 4, 4, 6), ("p_partkey % 13 = 0", 0, 1, 0, 1), ("p_partkey % 50 = 2", 0, 1, 700, 9))
    return " UNION ALL ".join(
        f"SELECT {file}, CAST(p_partkey * {len(kinds)} + {i} AS BIGINT) AS range_no, {row} + {r0} AS row_from, {c0} AS col_from, {row} + {r1} AS row_to, {c1} AS col_to FROM {{part}} WHERE {where}" for i, (where, r0, c0, r1, c1) in enumerate(kinds)
    )


VIEWS: dict[str, str] = {
    "products_raw": f"""
SELECT p_partkey AS idx, {_USER} AS user_id,
  CASE WHEN p_partkey % 23 = 0 THEN 'X' WHEN {_G} % 5 = 0 THEN 'S-' || CAST(p_partkey AS STRING)
    ELSE CASE p_partkey % 4 WHEN 1 THEN 'ab ' WHEN 2 THEN 'AB_' ELSE 'AB-' END || CAST({_G} AS STRING) END AS model,
  p_name AS name_zh,
  CASE WHEN p_partkey % 23 = 0 THEN 'warning only'
    WHEN {_G} % 3 = 0 THEN 'Motor: ' || CAST(p_size * 100 AS STRING) || 'W; Grade: ' || p_type
    ELSE 'Motor: ' || CAST((10 + {_G} % 40) * 100 AS STRING) || 'W; Grade: x' END AS spec_zh,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST(0 AS DOUBLE)
    ELSE CAST(round(CAST((100 + {_G}) * (100 + (p_partkey % 4) * (CASE WHEN {_G} % 2 = 0 THEN 1 ELSE 10 END)) AS DOUBLE) / 100, 2) AS DOUBLE) END AS price_rmb,
  'file' || lpad(CAST(p_partkey % 20 AS STRING), 2, '0') || '.xlsx' AS source_file,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'img/' || CAST(p_partkey AS STRING) || '.jpg' END AS image_path,
  {_DAY.format("p_partkey")} AS created_at
FROM {{part}}""",
    "products": f"""
SELECT p_partkey AS id, {_USER} AS user_id,
  CASE WHEN p_partkey % 37 = 0 THEN 'SKU:' || CAST(p_partkey AS STRING) WHEN p_partkey % 41 = 0 THEN 'SKU' || chr(10) || CAST(p_partkey AS STRING)
    ELSE 'SKU-' || CAST(p_partkey % 1500 AS STRING) END AS sku,
  p_name AS name_zh, p_type || ' ' || p_name AS name_en,
  CASE WHEN p_size % 9 = 0 THEN '' ELSE 'cat' || CAST(p_size % 5 AS STRING) END AS category,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS price_rmb,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(round(p_retailprice / 8 + 0.000000001, 2) AS DOUBLE) END AS price_usd,
  p_size AS moq, 1 + p_size % 12 AS units_per_carton, CAST(p_size AS DOUBLE) / 2 AS gross_weight, CAST(p_size AS DOUBLE) / 4 AS net_weight, CAST(p_size AS DOUBLE) / 64 AS cbm,
  CASE p_size % 4 WHEN 0 THEN 'CE, FCC' WHEN 1 THEN 'rohs' WHEN 2 THEN 'ISO9001' ELSE NULL END AS cert,
  'file' || lpad(CAST(p_partkey % 20 AS STRING), 2, '0') || '.xlsx' AS source_file,
  {_DAY.format("p_partkey")} AS created_at, {_DAY.format("(p_partkey * 5)")} AS updated_at
FROM {{part}}""",
    "incoming": """
SELECT id, user_id, CASE WHEN id % 2 = 0 THEN sku ELSE 'NEW-' || CAST(id AS STRING) END AS sku, name_zh, 'cat9' AS category,
  price_rmb + 1 AS price_rmb, price_usd, moq + 1 AS moq, updated_at FROM {products} WHERE id % 5 = 0""",
    "users": """
SELECT CASE c_custkey WHEN 0 THEN 'ev_alls' WHEN 1 THEN 'local' ELSE 'u' || CAST(c_custkey AS STRING) END AS id,
  CASE WHEN c_nationkey % 2 = 0 THEN 'free' ELSE 'pro' END AS tier, c_nationkey AS upload_count, '2024-01' AS upload_month FROM {customer}""",
    "order_lines": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, CASE l_partkey % 7 WHEN 0 THEN 'ev_alls' WHEN 1 THEN 'local' ELSE 'u' || CAST(l_partkey % 7 AS STRING) END AS user_id,
  CASE WHEN l_partkey % 11 = 0 THEN 'NONE-' || CAST(l_partkey AS STRING) ELSE ' SKU-' || CAST(l_partkey % 1500 AS STRING) || ' ' END AS sku,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS qty
FROM {lineitem}""",
    "quote_items": """
SELECT l_orderkey AS quote_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS line_no,
  l_partkey AS part_id, 'SKU-' || CAST(l_partkey AS STRING) AS sku, CAST(l_quantity AS INT) AS qty, CAST(round(l_extendedprice / l_quantity + 0.000000001, 2) AS DOUBLE) AS unit_price, p_size AS moq,
  CAST(p_size AS DOUBLE) / 4 AS nw, CAST(p_size AS DOUBLE) / 2 AS gw, CAST(p_size AS DOUBLE) / 64 AS cbm, 1 + p_size % 12 AS units_per_carton,
  CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' ELSE '' END AS currency
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "quotes": """
SELECT o_orderkey AS id, CASE o_custkey % 7 WHEN 0 THEN 'ev_alls' WHEN 1 THEN 'local' ELSE 'u' || CAST(o_custkey % 7 AS STRING) END AS user_id,
  '[' || CAST(o_orderkey % 2000 AS STRING) || ', ' || CAST((o_orderkey * 7) % 2000 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ', 999999999' ELSE '' END || ']' AS product_ids,
  CASE o_orderkey % 4 WHEN 0 THEN 'pi_' WHEN 1 THEN 'packing_' WHEN 2 THEN 'invoice_' ELSE 'quotation_' END || CAST(o_orderkey AS STRING) || '.xlsx' AS file_name,
  'K' || CAST(o_orderkey AS STRING) AS access_key, CAST(1704067200 + o_orderkey * 60 AS DOUBLE) AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1704067200 + o_orderkey * 60 + (o_orderkey % 9) * 86400 AS DOUBLE) END AS expires_at
FROM {orders}""",
    "price_texts": """
SELECT row_id, price, CASE row_id % 12 WHEN 0 THEN price WHEN 1 THEN '1,' || lpad(CAST(q AS STRING), 3, '0') || '.50' WHEN 2 THEN chr(165) || price WHEN 3 THEN '$' || CAST(q AS STRING)
    WHEN 4 THEN CAST(q AS STRING) || ' USD' WHEN 5 THEN CAST(q AS STRING) || '-' || CAST(q + 500 AS STRING) WHEN 6 THEN CAST(q AS STRING) || '~' || CAST(q + 100 AS STRING)
    WHEN 7 THEN CAST(q AS STRING) || 'K' WHEN 8 THEN CAST(q AS STRING) || 'W' WHEN 9 THEN CAST(q AS STRING) || '% off' WHEN 10 THEN 'EUR ' || CAST(q AS STRING) ELSE 'price: n/a' END AS text
FROM (SELECT l_partkey * 1000000 + row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS row_id,
    CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS price, CAST(l_quantity AS INT) AS q FROM {lineitem}) AS x""",
    "texts": """
SELECT p_partkey AS id, p_size AS s, p_name AS name, CASE p_partkey % 8
    WHEN 0 THEN CAST(p_size AS STRING) || '*' || CAST(p_size + 5 AS STRING) || '*3cm' WHEN 1 THEN 'Dia:' || CAST(p_size AS STRING) || 'cm H:20cm'
    WHEN 2 THEN 'L:' || CAST(p_size AS STRING) || ' W:5 H:3' WHEN 3 THEN CAST(p_size AS STRING) || ' x ' || CAST(p_size AS STRING) || ' inch' WHEN 4 THEN 'size ' || CAST(p_size AS STRING) || 'x20x30'
    WHEN 5 THEN 'nothing' WHEN 6 THEN CAST(p_size AS STRING) || 'x7mm' ELSE '' END AS dims,
  'Carton size: ' || CAST(p_size AS STRING) || 'x20x30; Gross weight: ' || CAST(p_size AS STRING) || '.5kg' || chr(10) || 'NW: ' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '; CBM: 0.12m' ELSE '' END
    || '; Pcs/ctn: ' || CAST(p_size AS STRING) || ' pcs; plain' || CASE WHEN p_partkey % 2 = 0 THEN '; Packing type: box; GW: 7' ELSE '' END AS packaging,
  CASE p_partkey % 6 WHEN 0 THEN 'Motor: ' || CAST(p_size AS STRING) || 'W; Range: 80km' WHEN 1 THEN 'Motor：500W;' WHEN 2 THEN '' WHEN 3 THEN 'Size: 1360*' WHEN 4 THEN 'Length:: 5 - ' ELSE '  Color: red  ;  Grade: ' || p_type END AS spec,
  CASE p_partkey % 9 WHEN 0 THEN 'Model ABC-' || CAST(p_partkey AS STRING) WHEN 1 THEN 'XF-' || CAST(p_partkey % 50 AS STRING) || ' red' WHEN 2 THEN 'G5000: fast' WHEN 3 THEN 'total' WHEN 4 THEN CAST(p_partkey AS STRING)
    WHEN 5 THEN 'AB12' || chr(10) || 'Motor: 1' WHEN 6 THEN 'payment terms' WHEN 7 THEN '12mm' ELSE p_name END AS model,
  CASE p_partkey % 5 WHEN 0 THEN '<b>' || p_name || '</b>' WHEN 1 THEN 'a & "b"' WHEN 2 THEN NULL ELSE p_name END AS html,
  CASE p_partkey % 5 WHEN 0 THEN '12.5' WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE '7' END AS number_text,
  p_retailprice AS price, p_type AS kind,
  CASE p_partkey % 3 WHEN 0 THEN '红色 锂电池 ABC' || chr(10) || 'red ' || p_name || chr(10) || '  ' || chr(10) WHEN 1 THEN '型号 EV12价格' ELSE p_name END AS zh,
  CASE WHEN p_partkey % 2 = 0 THEN '付款 ' || CAST(p_size AS STRING) || '  payment terms : T/T ' || p_name WHEN p_partkey % 3 = 0 THEN 'Terms of payment: ' || p_type ELSE '付款' END AS pay,
  CASE p_partkey % 5 WHEN 0 THEN '名 / ' || p_name WHEN 1 THEN p_name || '；' || p_type || ';x' WHEN 2 THEN ' 中<br>' || p_type || '<br>' || p_name || ' ' ELSE p_name END AS pair,
  CASE p_partkey % 4 WHEN 0 THEN '  Price (USD)  ' || p_type || ' (kg)' WHEN 1 THEN '价格(RMB)/Price(rmb) ' || p_type WHEN 2 THEN 'Weight(kg)(含电池)' ELSE p_name END AS head,
  CASE p_partkey % 3 WHEN 0 THEN 'a：（' || CAST(p_size AS STRING) || '）－＂x＇' WHEN 1 THEN '：' ELSE p_name || '（' END AS wide,
  CASE p_partkey % 3 WHEN 0 THEN 'Model: x' || chr(13) || chr(10) || 'Weight：' || CAST(p_size AS STRING) || chr(10) || chr(10) || 'Grade-' || p_type WHEN 1 THEN 'Weight: 1' || chr(10) || 'plain' || chr(10) || 'Weight: ' || p_name ELSE 'Colour（outer）: ' || p_type || chr(13) || 'x:' || chr(10) || '价格: 3' END AS fields,
  CASE p_partkey % 4 WHEN 0 THEN 'EV: CNY ' || CAST(4980 + p_size AS STRING) || ' / Battery: CNY 2,530 / Charger: CNY 230' WHEN 1 THEN 'Battery: 2530' || chr(10) || 'Charger ' || CAST(1000 + p_size AS STRING) WHEN 2 THEN 'Motor: USD ' || CAST(p_size AS STRING) || '.5/CKD: 900/EV 1000/none' ELSE p_name END AS parts
FROM {part}""",
    "zh_texts": f"""
SELECT p_partkey AS id, p_type AS kind, p_size AS s, {_phrase("p_partkey")} || CASE p_partkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN ' ' ELSE '' END || CAST(p_size AS STRING) || {_phrase("p_size")} || {_phrase("p_partkey + p_size")}
    || CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS zh FROM {{part}}""",
    "sheets": _sheets(),
    "merges": _merges(),
    "table_sheets": _table_sheets(),
    "invoice_cells": _invoice_cells(),
    "candidates": """
SELECT p_partkey % 20 AS file, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS parser, p_partkey AS row_no,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'payment' WHEN p_partkey % 13 = 0 THEN CAST(p_size AS STRING) || '-Long name ' || p_name WHEN p_partkey % 7 = 3 THEN p_name ELSE 'EV' || CAST(p_partkey % 300 AS STRING) END AS model,
  p_name AS name_zh, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN CAST(2024 AS DOUBLE) ELSE p_retailprice END AS price_rmb,
  CASE WHEN p_partkey % 3 = 0 THEN 'Motor 500W power rating' WHEN p_partkey % 3 = 1 THEN 'red' ELSE '' END AS spec_zh,
  CASE WHEN p_partkey % 20 < 10 THEN '' ELSE 'CNY' END AS currency
FROM {part}""",
    "cells": _cells(),
    "kv_cells": """
SELECT 'k' || CAST(CAST(floor(p_partkey / 30) AS BIGINT) AS STRING) AS file, p_partkey AS row_no,
  CASE p_partkey % 6 WHEN 0 THEN 'Model' WHEN 1 THEN 'Motor' WHEN 2 THEN 'Battery' WHEN 3 THEN 'Price' WHEN 4 THEN 'Color' ELSE 'Motor' END AS key,
  CASE p_partkey % 6 WHEN 0 THEN 'EV' || CAST(p_partkey AS STRING) WHEN 3 THEN CAST(p_retailprice AS STRING) ELSE p_name END AS value
FROM {part}""",
    "text_lines": """
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS doc_id, p_partkey AS pos,
  CASE p_partkey % 5 WHEN 0 THEN 'Model: EV' || CAST(p_partkey % 60 AS STRING) WHEN 1 THEN 'Price: ' || CAST(p_size AS STRING) || '.50' WHEN 2 THEN 'Name: ' || p_name WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Spec: red' ELSE 'Qty: ' || CAST(p_size AS STRING) END ELSE '' END AS line
FROM {part}""",
    "images": """
SELECT p_partkey AS idx, CASE p_partkey % 3 WHEN 0 THEN 'images/ab' || CAST(p_partkey AS STRING) || '.jpg' WHEN 1 THEN 'images/photo-' || CAST(p_partkey AS STRING) || '-front.png' ELSE 'images/misc' || CAST(p_partkey AS STRING) || '.jpg' END AS path,
  'f' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS file, CASE WHEN p_partkey % 3 = 0 THEN 'S1b' ELSE 's1' END AS sheet, CAST(p_partkey % 50 + p_partkey % 4 AS INT) AS row_no, CAST(floor(p_partkey / 10) AS INT) AS page, CAST(p_size AS DOUBLE) AS y
FROM {part} WHERE p_partkey % 2 = 0""",
    "pictured": """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'AB-' || CAST(p_partkey AS STRING) WHEN 1 THEN 'ab' || CAST(p_partkey - 1 AS STRING) WHEN 2 THEN CAST(p_partkey + 2 AS STRING) ELSE 'zz' END AS model,
  'f' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS file, CASE p_partkey % 4 WHEN 0 THEN 's1' WHEN 1 THEN ' S1' WHEN 2 THEN 'all s1 lamps' ELSE 'b' END AS sheet, CAST(p_partkey % 50 AS INT) AS row_no, CAST(floor(p_partkey / 10) AS INT) AS page
FROM {part}""",
    "expected": """
SELECT idx % 20 AS file, idx AS item, CASE WHEN idx % 7 = 0 THEN 'missing' ELSE upper(model) || ' ' END AS model, price_rmb * (CASE WHEN idx % 3 = 0 THEN 2.0 ELSE 1.01 END) AS price_rmb, 5.0 AS tolerance, name_zh AS name_keyword, 'Motor' AS spec_keyword
FROM {products_raw} WHERE idx % 4 = 0 AND price_rmb > 0""",
    "parsed": "SELECT idx % 20 AS file, idx AS row_no, model, name_zh, spec_zh, price_rmb FROM {products_raw}",
    "stored": """
SELECT model, spec_zh, price_rmb * (CASE WHEN idx % 3 = 0 THEN 1.5 ELSE 1.0 END) AS price_rmb, created_at AS last_updated, idx FROM {products_raw} WHERE idx % 2 = 0 AND model <> 'X'""",
    "events_v": """
SELECT event_id AS id, event_type AS event, CASE WHEN user_id % 50 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS session_id, props AS payload, ts AS created_at FROM {events}""",
    "payment_events": """
SELECT event_id AS id, CASE WHEN user_id % 50 = 0 THEN '' ELSE 'c' || CAST(user_id AS STRING) END AS user_id,
  CASE event_type WHEN 'view' THEN 'checkout.completed' WHEN 'signup' THEN 'subscription.active' WHEN 'click' THEN 'subscription.canceled' WHEN 'error' THEN 'subscription.past_due' ELSE 'refund.created' END AS type, ts FROM {events}""",
    "file_events": "SELECT event_id AS id, 'dir/' || CAST(user_id AS STRING) || CASE WHEN user_id % 3 = 0 THEN '.pdf' ELSE '.xlsx' END AS path, ts FROM {events}",
    "quote_views": "SELECT event_id AS id, user_id AS quote_id, CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE 'K' || CAST(user_id AS STRING) END AS access_key, 'm' || CAST(event_id % 10 AS STRING) || '@x' AS email, ts FROM {events}",
}


def _names(sql: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(sql) if f]


#: So many times.
MANY = 4
#: Views whose rows are numbered within a key of one table, by which they are worked out part by part.
NUMBERED = {"quote_items": ("lineitem", "l_orderkey")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame. A view that another one reads many times is worked out once, with the columns that are named there."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names = _names(VIEWS[name])
    inputs = {n: load(spark, sf_dir, n) for n in set(names)}
    for n in inputs:
        if n in VIEWS and names.count(n) >= MANY:
            used = [c for c in inputs[n].columns if re.search(rf"\b{c}\b", VIEWS[name])]
            inputs[n] = _in_parts(spark, sf_dir, n, used) if n in NUMBERED else staged(inputs[n].select(used), n)
    return spark.sql(VIEWS[name], **inputs)


def _in_parts(spark: SparkSession, sf_dir: str, name: str, used: list[str]) -> DataFrame:
    table, key = NUMBERED[name]
    own = {n: load(spark, sf_dir, n) for n in set(_names(VIEWS[name]))}
    return staged_in_parts(lambda rows: spark.sql(VIEWS[name], **(own | {table: rows})).select(used), own[table], name, key)


def with_views(names: list[str], sql: str) -> str:
    """sql with the views, and those that they need, before it."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in order:
            for m in _names(VIEWS[n]):
                need(m)
            order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({VIEWS[n].format(**{m: m for m in _names(VIEWS[n])})})" for n in order]
    sql = sql.strip()
    if sql.upper().startswith("SELECT"):
        return (f"WITH {', '.join(parts)} " if parts else "") + sql
    return f"WITH RECURSIVE {', '.join([*parts, sql])}"
