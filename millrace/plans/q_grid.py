"""Sheets and texts to product rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import header_words as W
from .registry import query

C = F.col
COLS = {1: "model", 2: "name", 3: "spec", 4: "price_text"}
_WIDE = "wd AS (SELECT file, sheet, row_no, coalesce(max(CASE WHEN col_no = 1 THEN value END), '') AS model, coalesce(max(CASE WHEN col_no = 2 THEN value END), '') AS name, coalesce(max(CASE WHEN col_no = 3 THEN value END), '') AS spec, coalesce(max(CASE WHEN col_no = 4 THEN value END), '') AS price_text FROM cells GROUP BY ALL)"


def body(c):
    return G.wide(c, COLS).where("row_no > 3")


def _any(words, text: str) -> str:
    """Whether text holds one of the words, in SQL."""
    return f"(len(list_filter({list(words)}, lambda w: contains({text}, w))) > 0)"


_HEADERS = f"""h1 AS (SELECT file, sheet, row_no, trim(value) AS v, lower(trim(value)) AS low FROM sheets WHERE row_no BETWEEN 1 AND 29 AND trim(value) <> ''),
h2 AS (SELECT file, sheet, row_no, count(*) AS n, sum(CASE WHEN length(v) > 30 THEN 3 ELSE 0 END) AS off, sum(CASE WHEN list_contains({list(W.HEADER_WORDS)}, low) THEN 2 WHEN {_any(W.HEADER_PARTS, 'low')} THEN 1 ELSE 0 END + CASE WHEN {_any(W.PRICE_WORDS, 'low')} THEN CASE WHEN row_no <= 15 THEN 10 ELSE 3 END ELSE 0 END) AS points FROM h1 GROUP BY ALL),
h3 AS (SELECT *, (points - off) * CASE WHEN n <= 2 AND off > 0 THEN 0.3::DOUBLE ELSE 1 END AS score FROM h2),
heads AS (SELECT file, sheet, coalesce(min(row_no) FILTER (row_no > 1 AND score >= 10 AND n >= 3), CASE WHEN max(score) >= 2 THEN arg_max(row_no, score * 1000 - row_no) END, 1) AS header FROM h3 GROUP BY ALL)"""
_HITS = {r: _any(ws, "head") for r, ws in W.ROLES.items()}
_HITS["model"] += f" AND NOT serial AND NOT ({_HITS['spec']} AND {_any(W.STRONG_SPEC, 'head')} AND NOT {_any(W.STRONG_MODEL, 'head')})"
_HITS["name"] += " AND NOT serial"
_N = len(W.ROLES)
#: Columns taken one by one, from the left, by a recursion over their places.
_MAPPED = f"""{_HEADERS},
f1 AS (SELECT s.file, s.sheet, col_no, row_no, row_no - header AS below, trim(value) AS v FROM sheets s JOIN heads USING (file, sheet)),
f2 AS (SELECT file, sheet, col_no, coalesce(max(lower(v)) FILTER (below = 0), '') AS head, count(*) FILTER (row_no BETWEEN 1 AND 20 AND v <> '') AS top, count(*) FILTER (row_no BETWEEN 1 AND 20 AND regexp_matches(v, '^\\d{{1,4}}$') AND TRY_CAST(v AS INT) >= 1) AS serials,
  count(*) FILTER (v <> '' AND below BETWEEN 1 AND 15) AS next, count(*) FILTER (v LIKE '=%' AND below BETWEEN 1 AND 15) AS formulas, count(*) FILTER (v <> '' AND below BETWEEN 1 AND 9) AS contents,
  count(*) FILTER (below BETWEEN 1 AND 9 AND regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9\\-_\\./]+$') AND NOT regexp_matches(v, '^\\d+$')) AS models, count(*) FILTER (below BETWEEN 1 AND 4 AND TRY_CAST(v AS DOUBLE) IS NOT NULL) > 0 AS number FROM f1 GROUP BY ALL),
f3 AS (SELECT *, top >= 3 AND serials >= 0.8 * top AS serial, next >= 3 AND formulas >= 0.5 * next AS formula FROM f2),
f4 AS (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY col_no) AS pos, head <> '' AND NOT {_any(W.SKIPPED, 'head')} AND NOT formula AS usable, [{', '.join(_HITS.values())}] AS hits FROM f3),
m AS (SELECT file, sheet, 0 AS pos, list_transform(range({_N}), lambda x: CAST(NULL AS INT)) AS taken FROM heads
  UNION ALL SELECT m.file, m.sheet, f4.pos, list_transform(range(1, {_N + 1}), lambda i: CASE WHEN usable AND i = list_position(list_transform(range(1, {_N + 1}), lambda j: taken[j] IS NULL AND hits[j]), true) THEN col_no ELSE taken[i] END) FROM m JOIN f4 ON f4.file = m.file AND f4.sheet = m.sheet AND f4.pos = m.pos + 1),
z AS (SELECT file, sheet, arg_max(taken, pos) AS t FROM m GROUP BY ALL),
y AS (SELECT z.*, coalesce(t[1], (SELECT arg_max(col_no, models * 100 - col_no) FROM f4 WHERE f4.file = z.file AND f4.sheet = z.sheet AND col_no <= 30 AND contents >= 2 AND models > 0 AND models >= 0.5 * contents)) AS model, coalesce(t[3], t[1]) AS name FROM z),
mapped AS (SELECT file, sheet, model, t[2] AS spec, name, coalesce(t[4], (SELECT min(col_no) FROM f4 WHERE f4.file = y.file AND f4.sheet = y.sheet AND number AND NOT coalesce(list_contains([model, name] || t[2:2] || t[4:8], col_no), false))) AS price, {', '.join(f't[{i}] AS {r}' for i, r in enumerate(W.ROLES, 1) if i > 4)} FROM y)"""


@query("header_row", "sheets", sql=f"{_HEADERS} SELECT * FROM heads")
def header_row(c):
    return G.header_row(c)


@query("header_mapping", "sheets", sql=f"{_MAPPED} SELECT * FROM mapped")
def header_mapping(c):
    return G.header_mapping(c, G.header_row(c))


@query("sheet_currency", "sheets", sql=f"""{_MAPPED} SELECT s.file, s.sheet, CASE WHEN max(CASE WHEN s.row_no = h.header THEN {_any(('usd', '$', 'fob', 'cif', 'cfr', 'dap', 'ddp'), 'lower(value)')} ELSE {_any(('$', 'usd'), 'lower(value)')} END) THEN 'USD' ELSE 'CNY' END AS currency
FROM sheets s JOIN heads h USING (file, sheet) JOIN mapped p ON p.file = s.file AND p.sheet = s.sheet AND p.price = s.col_no WHERE s.row_no BETWEEN h.header AND h.header + 4 GROUP BY ALL""")  # fmt: skip
def sheet_currency(c):
    h = G.header_row(c)
    return G.sheet_currency(c, h, G.header_mapping(c, h))


def _head_role() -> str:
    """The role that a header's words give, in SQL over head and its words ws."""
    short = lambda w: len(w.rstrip("$¥() ")) <= 3
    one = lambda ws: " OR ".join(f"list_contains(ws, '{w}')" if short(w) else f"contains(head, '{w}')" for w in ws)
    return "CASE " + " ".join(f"WHEN {one(ws)} THEN '{r}'" for r, ws in W.HEAD_ROLES.items()) + " END"


@query("column_roles", "sheets", sql=f"""{_HEADERS},
c1 AS (SELECT s.file, s.sheet, col_no, row_no - header AS below, trim(value) AS v, lower(trim(value)) AS low FROM sheets s JOIN heads USING (file, sheet) WHERE row_no - header BETWEEN 0 AND 59),
c2 AS (SELECT *, regexp_matches(v, '^\\d+$') AS whole, TRY_CAST(regexp_replace(v, '[¥$€£USDusd,\\s]', '', 'g') AS DOUBLE) AS number FROM c1),
c3 AS (SELECT file, sheet, col_no, coalesce(max(low) FILTER (below = 0), '') AS head, count(*) FILTER (below > 0 AND v <> '') AS total, count(*) FILTER (below > 0 AND whole AND TRY_CAST(v AS BIGINT) BETWEEN 1 AND 999) AS serials,
  count(*) FILTER (below > 0 AND list_contains({list(W.LABELS)}, low)) AS labels, count(*) FILTER (below > 0 AND v <> '' AND {_any(W.PACKAGING_WORDS, 'low')}) + count(*) FILTER (below > 0 AND v <> '' AND {_any(W.PACKAGING_CONTENT, 'low')}) AS packaging,
  count(*) FILTER (below > 0 AND regexp_matches(v, '[A-Za-z]+\\d+')) AS models, count(*) FILTER (below > 0 AND v <> '' AND number > 0.001 AND number < 10000000) AS prices, count(*) FILTER (below > 0 AND v <> '' AND NOT whole) AS texts, coalesce(avg(length(v)) FILTER (below > 0 AND v <> ''), 0) AS width FROM c2 GROUP BY ALL),
c4 AS (SELECT *, {_head_role()} AS said FROM (SELECT *, string_split_regex(translate(head, '/-()', '    '), '\\s+') AS ws FROM c3))
SELECT file, sheet, col_no, total, serials, labels, packaging, models, prices, CASE WHEN said IN ('skip', 'packaging') THEN said WHEN {_any(W.SKIPPED_COLUMNS, 'head')} OR total = 0 THEN 'skip' WHEN said IS NOT NULL THEN said
  WHEN packaging >= greatest(1, total * 0.15::DOUBLE) THEN 'packaging' WHEN serials >= greatest(3, total * 0.8::DOUBLE) AND texts = 0 THEN 'skip' WHEN labels >= greatest(2, total * 0.3::DOUBLE) THEN 'label'
  WHEN prices >= greatest(2, total * 0.2::DOUBLE) AND texts > 0 THEN 'price' WHEN models >= greatest(2, total * 0.15::DOUBLE) OR width < 25 THEN 'model' ELSE 'spec' END AS role FROM c4""")  # fmt: skip
def column_roles(c):
    return G.column_roles(c, G.header_row(c))


@query("sheet_layout", "sheets", sql=f"""l AS (SELECT *, lower(trim(value)) AS low FROM sheets),
g AS (SELECT file, sheet, count(*) FILTER (col_no = 1 AND regexp_matches(low, '[:：]$')) AS colons, count(*) FILTER (regexp_matches(low, '^model[:：]')) AS params, count(*) FILTER (contains(low, 'commercial invoice') OR contains(low, 'proforma invoice')) AS invoices,
  count(*) FILTER (row_no <= 10 AND {_any(G.PRICE_HEADS, 'low')}) AS prices, count(DISTINCT CASE WHEN row_no <= 3 AND regexp_matches(low, '^[a-z]+-?\\d+$') THEN col_no END) AS across,
  max(row_no) FILTER (low <> '') AS last, max(col_no) FILTER (low <> '') AS width, count(*) FILTER (low <> '' AND col_no = 1 AND row_no BETWEEN 2 AND 11) AS firsts FROM l GROUP BY ALL)
SELECT file, sheet, CASE WHEN colons >= 4 THEN 'kv' WHEN params > 0 THEN 'param_list' WHEN invoices > 0 THEN 'invoice' WHEN prices > 0 THEN 'price' WHEN across >= 2 THEN 'horizontal' WHEN last > 10 AND width < 6 AND firsts > 0 THEN 'single_spec' ELSE 'vertical' END AS layout FROM g""")  # fmt: skip
def sheet_layout(c):
    return G.sheet_layout(c)


@query("blank_run_cutoff", "sheets", sql="""w AS (SELECT file, sheet, row_no FROM sheets WHERE row_no > 1 AND trim(value) <> '' GROUP BY ALL),
b AS (SELECT a.file, a.sheet, min(a.row_no) AS stop FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.file = a.file AND b.sheet = a.sheet AND b.row_no BETWEEN a.row_no + 1 AND a.row_no + 20) GROUP BY ALL)
SELECT w.file, w.sheet, w.row_no FROM w JOIN b USING (file, sheet) WHERE w.row_no <= b.stop""")  # fmt: skip
def blank_run_cutoff(c):
    rows = G.wide(c, COLS | {5: "more"}).where("row_no > 1")
    return G.blank_run_cutoff(rows, [*COLS.values(), "more"]).select("file", "sheet", "row_no")


@query("forward_fill_model", "cells", sql=f"{_WIDE} SELECT file, row_no, coalesce(last_value(nullif(model, '') IGNORE NULLS) OVER (PARTITION BY file, sheet ORDER BY row_no), '') AS filled FROM wd WHERE row_no > 3")
def forward_fill_model(c):
    return G.fill_down(body(c), G.SHEET, "row_no", "model", "filled").select("file", "row_no", "filled")


@query("fill_merged_cells", "cells", sql="SELECT file, row_no, col_no, coalesce(last_value(nullif(value, '') IGNORE NULLS) OVER (PARTITION BY file, sheet, col_no ORDER BY row_no), '') AS filled FROM cells WHERE row_no > 3")
def fill_merged_cells(c):
    return G.fill_merged_cells(c, G.header_row(c)).select("file", "row_no", "col_no", "filled")


@query("attach_remarks", "cells", sql=f"""{_WIDE},
x AS (SELECT *, CASE WHEN contains(lower(model), 'remark') THEN concat_ws(' ', nullif(name, ''), nullif(spec, '')) WHEN contains(lower(model), 'battery') THEN '[电池] ' || concat_ws(' ', nullif(name, ''), nullif(spec, '')) END AS extra FROM wd WHERE row_no > 3),
y AS (SELECT *, sum(CASE WHEN extra IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file, sheet ORDER BY row_no) AS product FROM x)
SELECT file, min(row_no) AS row_no, arg_min(model, row_no) AS model, coalesce(string_agg(extra, ' ' ORDER BY row_no), '') AS remark FROM y WHERE product > 0 GROUP BY file, sheet, product""")  # fmt: skip
def attach_remarks(c):
    return G.attach_remarks(body(c), "model", ["name", "spec"]).select("file", "row_no", "model", "remark")


def _sql_pattern(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


#: First cells that the rules take apart, beside those of the sheets: document lines, order numbers, skip words, shapes.
_FIRST = "CASE row_no % 11 WHEN 0 THEN 'Payment: T/T' WHEN 1 THEN 'PO-2024010' || (row_no % 3) WHEN 2 THEN 'Certificate of origin' WHEN 3 THEN '收货人 ' || name WHEN 4 THEN '3. Delivery terms' WHEN 5 THEN name || ' (' || spec || ')' WHEN 6 THEN '50件以下 含税价' WHEN 7 THEN 'Golden Lamp' WHEN 8 THEN 'price term' WHEN 9 THEN 'XY/' || row_no ELSE model END"
_PRODUCT = f"""x AS (SELECT file, row_no, {_FIRST} AS f, CASE WHEN row_no % 5 = 0 THEN 'about ' || (row_no % 3) || ' pcs' ELSE '' END AS qty, CASE WHEN row_no % 4 = 0 THEN price_text ELSE '' END AS price FROM wd)
SELECT file, row_no, CASE WHEN f = '' OR length(f) > 200 OR regexp_matches(trim(lower(f)), '{_sql_pattern(W.DOCUMENT_LINES)}') THEN false WHEN regexp_matches(f, '[A-Za-z]+\\d+') AND length(f) < 40 THEN NOT regexp_matches(f, '(?i){W.ORDER_NUMBER}')
  WHEN coalesce(TRY_CAST(regexp_extract(replace(price, ',', ''), '\\d+(?:\\.\\d+)?') AS DOUBLE) > 0, false) THEN true WHEN coalesce(TRY_CAST(regexp_extract(qty, '\\d+') AS BIGINT) > 0, false) AND length(f) < 100 THEN true
  WHEN {_any(W.SKIP_WORDS, 'lower(f)')} OR (regexp_matches(f, '^\\d+') AND regexp_matches(f, '以下|以上|包邮|执行')) THEN false
  ELSE (regexp_matches(f, '[（(][^）)]*[)）]') AND length(f) < 60) OR regexp_matches(f, '[A-Za-z]+[\\d\\-/]+') OR regexp_matches(f, '[A-Z][a-z]+\\s[A-Z][a-z]+') END AS product FROM x"""


@query("is_product_row", "cells", sql=f"{_WIDE}, {_PRODUCT}")
def is_product_row(c):
    x = G.wide(c, COLS)
    qty = F.when(C("row_no") % 5 == 0, F.concat(F.lit("about "), (C("row_no") % 3).cast("string"), F.lit(" pcs"))).otherwise("")
    return x.select("file", "row_no", G.is_product_row(F.expr(_FIRST), qty, F.when(C("row_no") % 4 == 0, C("price_text")).otherwise("")).alias("product"))


_LINE = "CASE row_no % 17 WHEN 0 THEN 'payment' WHEN 1 THEN '3. 支付方式' WHEN 2 THEN '(Signed by)' WHEN 3 THEN 'UOM: pcs' WHEN 4 THEN '2. Port of loading' WHEN 5 THEN 'Made in ' || name_zh WHEN 6 THEN '产品_R7' WHEN 7 THEN 'PO20240101' WHEN 8 THEN '不可抗力' WHEN 9 THEN 'USD 1,200' WHEN 10 THEN 'Total : 5' ELSE model END"
_NOTE = "CASE WHEN row_no % 19 = 0 THEN '本产品不含电池以及充电器需要客户自行购买并且安装好之后才能使用' ELSE spec_zh END"


@query("non_product_rows", "candidates", sql=f"""x AS (SELECT row_no, trim({_LINE}) AS m, concat_ws(' ', nullif(trim({_LINE}), ''), nullif(trim(name_zh), ''), nullif(trim({_NOTE}), '')) AS line FROM candidates)
SELECT row_no FROM x WHERE line <> '' AND NOT regexp_matches(m, '{_sql_pattern(W.NON_PRODUCT)}') AND NOT regexp_matches(lower(line), '{_sql_pattern(W.NON_PRODUCT)}') AND NOT (NOT (regexp_matches(m, '[A-Za-z0-9]') AND length(m) >= 2) AND length(regexp_replace(line, '[^一-鿿]', '', 'g')) > 20 AND length(line) > 12)""")  # fmt: skip
def non_product_rows(c):
    return c.where(~G.is_non_product(F.expr(_LINE), C("name_zh"), F.expr(_NOTE))).select("row_no")


_SOLO = "SELECT CASE WHEN row_no % 9 = 0 THEN 'solo' || row_no ELSE 'f' || file END AS file, CASE row_no % 36 WHEN 0 THEN 'list.xlsx' WHEN 18 THEN 'Item_' || row_no WHEN 1 THEN 'a.pdf' ELSE model END AS model, row_no FROM {0}"


@query("single_row_filename_filter", "parsed", sql=f"x AS ({_SOLO.format('parsed')}) SELECT row_no FROM x QUALIFY NOT (count(*) OVER (PARTITION BY file) = 1 AND regexp_matches(lower(model), '\\.(xlsx?|pdf|docx?|csv)$|^(产品_r\\d+|item_\\d+)$'))")
def single_row_filename_filter(p):
    return G.single_row_filter(p.sparkSession.sql(_SOLO.format("{p}"), p=p), "file").select("row_no")


_NAMED = "SELECT CASE id % 7 WHEN 0 THEN '' WHEN 3 THEN 'Product NAME' ELSE model END AS m, CASE WHEN id % 14 = 0 OR id % 5 = 0 THEN '  ' ELSE name END AS n FROM {0}"


@query("normalize_frame", "texts", sql=f"x AS ({_NAMED.format('texts')}) SELECT m AS model, n AS name FROM x WHERE NOT (trim(m) = '' AND trim(n) = '') AND lower(regexp_replace(m, '^\\s+|\\s+$', '', 'g')) NOT IN ('model', 'total', 'product name')")
def normalize_frame(t):
    t = t.sparkSession.sql(_NAMED.format("{t}"), t=t)
    return G.normalize_frame(t.select(C("m").alias("Item No. model"), C("n").alias("Product name")), {"model": ["model", "total"], "name": ["product name"]})


@query("segment_by_marker", "kv_cells", sql="""x AS (SELECT *, CAST(sum(CASE WHEN key = 'Model' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY row_no) AS BIGINT) AS segment FROM kv_cells)
SELECT file, segment, max(CASE WHEN key = 'Model' THEN value END) AS model, TRY_CAST(arg_max(value, row_no) FILTER (key = 'Price') AS DOUBLE) AS price, coalesce(string_agg(key || ': ' || value, '; ' ORDER BY row_no) FILTER (key NOT IN ('Model', 'Price')), '') AS spec FROM x WHERE segment > 0 GROUP BY 1, 2""")  # fmt: skip
def segment_by_marker(k):
    return G.segment_by_marker(k, ["file"], "row_no", "key", "value")


@query("kv_single_product", "kv_cells", sql="SELECT file, arg_min(value, row_no) FILTER (key = 'Model') AS model, TRY_CAST(arg_min(value, row_no) FILTER (key = 'Price') AS DOUBLE) AS price, coalesce(string_agg(key || ': ' || value, '; ' ORDER BY row_no) FILTER (key NOT IN ('Model', 'Price')), '') AS spec FROM kv_cells GROUP BY 1")
def kv_single_product(k):
    return G.kv_single_product(k, ["file"], "row_no", "key", "value")


_SPECS = "SELECT {0}, count(*) AS n, array_to_string(list(t ORDER BY o)[1:50], '; ') AS spec FROM (SELECT {0}, substr({1}, 1, 50) AS head, min({2}) AS o, arg_min({1}, {2}) AS t FROM {3} GROUP BY ALL) GROUP BY {0}"


@query("aggregate_specs", "products_raw", sql=_SPECS.format("model", "name_zh", "idx", "products_raw"))
def aggregate_specs(p):
    return G.aggregate_specs(p, ["model"], "idx", "name_zh")


@query("param_list_products", "kv_cells", sql="""x AS (SELECT *, CAST(sum(CASE WHEN key = 'Model' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY row_no) AS BIGINT) AS segment FROM kv_cells),
y AS (SELECT file, segment, key || ': ' || value AS spec, row_no FROM x WHERE segment > 0 AND key <> 'Model' QUALIFY row_number() OVER (PARTITION BY file, segment, key ORDER BY row_no) = 1)
SELECT file, segment, count(*) AS n, string_agg(spec, '; ' ORDER BY row_no) AS spec FROM y GROUP BY 1, 2""")  # fmt: skip
def param_list_products(k):
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    r = k.withColumn("segment", F.sum(F.when(C("key") == "Model", 1).otherwise(0)).over(w)).where("segment > 0 and key != 'Model'")
    first = r.groupBy("file", "segment", F.substring("key", 1, 50).alias("name")).agg(F.min_by(F.struct("key", "value"), "row_no").alias("x"), F.min("row_no").alias("row_no"))
    return G.aggregate_specs(first.select("file", "segment", "row_no", F.concat("x.key", F.lit(": "), "x.value").alias("text")), ["file", "segment"], "row_no", "text")


#: The labelled lines, and the lines of all documents.
_ALL_LINES = """al AS (SELECT doc_id, pos, line FROM text_lines UNION ALL SELECT doc_id + 1000000000, i - 1, ls[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i))"""


def all_lines(t, d):
    d = d.where("text is not null").select((C("doc_id") + 1_000_000_000).alias("doc_id"), F.split("text", "\n", -1).alias("lines"))
    return t.select("doc_id", "pos", "line").unionByName(d.select("doc_id", F.posexplode("lines").alias("pos", "line")))


_LABEL = "nullif(regexp_extract(line, '(?i)^\\s*(?:{0})\\s*[:：]\\s*(.+)$', 1), '')"
_LABELLED = ", ".join(f"{_LABEL.format(words)} AS {name}" for name, words in (("model", "model|型号"), ("price", "price|价格"), ("name", "name|名称"), ("spec", "spec|规格"), ("qty", "qty|数量")))


@query("text_blocks_to_products", "text_lines", "documents", sql=f"""{_ALL_LINES}, x AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM al),
y AS (SELECT doc_id, block, pos, {_LABELLED} FROM x WHERE trim(line) <> '')
SELECT doc_id, block, min(pos) AS first, arg_max(model, pos) AS model, TRY_CAST(arg_max(price, pos) AS DOUBLE) AS price, arg_max(name, pos) AS name, arg_max(spec, pos) AS spec, arg_max(qty, pos) AS qty FROM y GROUP BY 1, 2""")  # fmt: skip
def text_blocks_to_products(t, d):
    return G.text_blocks(all_lines(t, d), "doc_id", "pos", "line")


@query("document_blocks", "documents", sql="""l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
x AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS block FROM l)
SELECT doc_id, block, min(i) - 1 AS first FROM x WHERE trim(line) <> '' GROUP BY 1, 2""")  # fmt: skip
def document_blocks(d):
    """Blocks of lines of real texts, for volume."""
    lines = d.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return G.text_blocks(lines, "doc_id", "pos", "line").select("doc_id", "block", "first")


@query("suffix_repeated_models", "text_lines", "documents", sql=f"""{_ALL_LINES}, x AS (SELECT doc_id, pos, CASE WHEN line LIKE 'Model:%' THEN 'EV' || pos % 3 WHEN line LIKE 'Name:%' THEN NULL ELSE substr(line, 1, 4) END AS model FROM al WHERE trim(line) <> '')
SELECT doc_id, pos, CASE WHEN coalesce(model, '') = '' THEN 'OCR-' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) WHEN row_number() OVER (PARTITION BY doc_id, model ORDER BY pos) > 1 THEN model || '-' || row_number() OVER (PARTITION BY doc_id, model ORDER BY pos) ELSE model END AS unique_model FROM x""")  # fmt: skip
def suffix_repeated_models(t, d):
    model = F.when(C("line").startswith("Model:"), F.concat(F.lit("EV"), (C("pos") % 3).cast("string"))).when(C("line").startswith("Name:"), None).otherwise(F.substring("line", 1, 4))
    x = all_lines(t, d).where(F.trim("line") != "").select("doc_id", "pos", model.alias("model"))
    return G.suffix_repeated(x, "doc_id", "pos", "model").select("doc_id", "pos", "unique_model")


@query("price_table_rows", "cells", sql=f"{_WIDE} SELECT file, row_no, model, name || CASE WHEN spec <> '' THEN '; ' || spec ELSE '' END AS spec, TRY_CAST(price_text AS DOUBLE) AS price FROM wd WHERE row_no > 3 AND price_text <> ''")
def price_table_rows(c):
    spec = F.concat_ws("; ", F.nullif(C("name"), F.lit("")), F.nullif(C("spec"), F.lit("")))
    return body(c).where("price_text != ''").select("file", "row_no", "model", spec.alias("spec"), C("price_text").try_cast("double").alias("price"))


@query("horizontal_unpivot", "cells", sql="""m AS (SELECT file, col_no, value AS model FROM cells WHERE row_no = 3 AND col_no > 1), n AS (SELECT file, row_no, value AS name FROM cells WHERE row_no > 3 AND col_no = 1 AND value <> '')
SELECT c.file, c.col_no, model, string_agg(name || ': ' || trim(c.value), chr(10) ORDER BY c.row_no) AS spec FROM cells c JOIN m ON m.file = c.file AND m.col_no = c.col_no JOIN n ON n.file = c.file AND n.row_no = c.row_no WHERE c.value <> '' GROUP BY ALL""")  # fmt: skip
def horizontal_unpivot(c):
    return G.horizontal_unpivot(c, 1, 3).select("file", "col_no", "model", "spec")


@query("vertical_rows", "cells", sql=f"{_WIDE} SELECT file, row_no, substr(trim(model), 1, 30) AS model, TRY_CAST(regexp_extract(price_text, '\\d+(?:\\.\\d+)?') AS DOUBLE) AS price FROM wd WHERE row_no > 3 AND (model <> '' OR price_text <> '')")
def vertical_rows(c):
    return G.vertical_rows(body(c)).select("file", "row_no", "model", "price")


@query("invoice_rows", "quote_items", sql="""x AS (SELECT quote_id, line_no, CASE WHEN line_no % 5 = 0 THEN 'Total: ' ELSE sku END AS model, qty, CASE WHEN line_no % 2 = 0 THEN NULL ELSE unit_price END AS unit_price, qty * unit_price AS total FROM quote_items)
SELECT quote_id, line_no, model, round(coalesce(unit_price, total / qty), 4) AS unit_price, round(total, 4) AS total FROM x WHERE line_no % 5 <> 0""")  # fmt: skip
def invoice_rows(q):
    x = q.select("quote_id", "line_no", F.when(C("line_no") % 5 == 0, "Total: ").otherwise(C("sku")).alias("model"), "qty", F.when(C("line_no") % 2 != 0, C("unit_price")).alias("unit_price"), (C("qty") * C("unit_price")).alias("total"))
    return G.invoice_rows(x).select("quote_id", "line_no", "model", F.round("unit_price", 4).alias("unit_price"), F.round("total", 4).alias("total"))


@query("union_sheets", "products_raw", "products", sql="SELECT idx, model, NULL AS sku, 0 AS frame_no FROM products_raw UNION ALL SELECT id, NULL, sku, 1 FROM products")
def union_sheets(a, b):
    return G.union_all([a.select("idx", "model"), b.select(C("id").alias("idx"), "sku")]).select("idx", "model", "sku", "frame_no")


@query("cross_table_price", "cells", sql=f"""{_WIDE},
p AS (SELECT file, row_no, row_number() OVER (PARTITION BY file ORDER BY row_no) AS i FROM wd WHERE row_no BETWEEN 4 AND 23),
n AS (SELECT file, col_no, arg_min(TRY_CAST(replace(regexp_extract(value, '[\\d,]+(?:\\.\\d+)?'), ',', '') AS DOUBLE), row_no) AS price FROM cells WHERE row_no > 26 AND TRY_CAST(replace(regexp_extract(value, '[\\d,]+(?:\\.\\d+)?'), ',', '') AS DOUBLE) > 0 GROUP BY 1, 2)
SELECT p.file, p.row_no, n.price FROM p JOIN n ON n.file = p.file AND n.col_no = p.i""")  # fmt: skip
def cross_table_price(c):
    """Blank rows part a sheet into two tables: the products of the first, prices across the second."""
    products = G.wide(c, COLS).where("row_no between 4 and 23").select("file", "row_no", F.lit(None).cast("double").alias("price"))
    return G.cross_table_price(products, c.where("row_no > 26"))
