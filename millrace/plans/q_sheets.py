"""Merged ranges and invoice sheets, from the cells."""

from __future__ import annotations

from ..functions.prices import CURRENCIES, YUAN
from ..operators import invoices as I
from ..operators import merged as R
from ..operators import tables as T
from ..sources.staging import staged_in_parts
from .q_grid import _HEADERS, _MAPPED, _any
from .q_quality import _ROW, YEAR
from .registry import query


@query("fill_merged_ranges", "cells", "merges", sql="""own AS (SELECT file, sheet, row_no, col_no, value FROM cells WHERE value <> ''),
place AS (SELECT file, sheet, row_no, col_no FROM (SELECT DISTINCT file, sheet, row_no FROM own), unnest(range(1, 12)) AS u(col_no)),
shown AS (SELECT p.*, arg_max(coalesce(t.value, ''), range_no) AS value FROM place p JOIN merges m ON m.file = p.file AND m.sheet = p.sheet AND p.row_no BETWEEN row_from AND row_to AND p.col_no BETWEEN col_from AND col_to
  LEFT JOIN own t ON t.file = m.file AND t.sheet = m.sheet AND t.row_no = row_from AND t.col_no = col_from GROUP BY ALL)
SELECT file, row_no, col_no, coalesce(o.value, s.value) AS value FROM own o FULL JOIN shown s USING (file, sheet, row_no, col_no) WHERE coalesce(o.value, s.value) <> ''""")  # fmt: skip
def fill_merged_ranges(c, m):
    return R.merged_values(c, m).select("file", "row_no", "col_no", "value")


def _price(c: str) -> str:
    """cell_price in SQL."""
    numbers = f"list_filter(list_transform(regexp_extract_all({c}, '[\\d,]+(?:\\.\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)"
    code = "CASE " + " ".join(f"WHEN contains(upper({c}), '{sign}') THEN {YUAN.get(name, 1.0)}" for sign, name in CURRENCIES) + " ELSE 1.0 END"
    return f"CASE WHEN coalesce({c}, '') = '' THEN NULL WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN CASE WHEN TRY_CAST({c} AS DOUBLE) > 0 THEN TRY_CAST({c} AS DOUBLE) END ELSE {numbers}[1] * {code} END"


_WORDS = "|".join(w.replace(".", "\\.").replace("$", "\\$") for w in I.NO_GOODS)


@query("invoice_sheet_rows", "invoice_cells", sql=f"""v AS (SELECT file, row_no, col_no, max(value) AS v FROM invoice_cells WHERE value <> '' GROUP BY ALL),
h AS (SELECT file, coalesce(min(row_no) FILTER (col_no = 1 AND row_no < 25 AND regexp_matches(lower(v), 'description|item')), max(3) FILTER (col_no = 1 AND row_no = 3), 1) AS header FROM v GROUP BY file),
s AS (SELECT file, max(col_no) AS width FROM invoice_cells GROUP BY file HAVING max(col_no) > 5 OR bool_or(col_no = 1 AND row_no < 20 AND regexp_matches(lower(value), 'proforma|invoice|description'))),
k AS (SELECT h.file, h.header, coalesce(max(col_no) FILTER (width >= 6 AND regexp_matches(lower(v), 'quantity|qty')), 4) AS q, coalesce(max(col_no) FILTER (width >= 6 AND regexp_matches(lower(v), 'unit.*price|price.*unit') AND NOT regexp_matches(lower(v), 'quantity|qty')), 5) AS p,
  coalesce(max(col_no) FILTER (width >= 6 AND lower(v) = 'total amount'), 6) AS t, CASE WHEN coalesce(bool_or(col_no = 5 AND regexp_matches(lower(v), 'usd|\\$|fob|cif|cfr|dap|ddp')), false) THEN 'USD' ELSE 'RMB' END AS currency
  FROM h JOIN s USING (file) LEFT JOIN v ON v.file = h.file AND v.row_no = h.header GROUP BY h.file, h.header),
r AS (SELECT k.file, v.row_no, any_value(header) AS header, any_value(currency) AS currency, trim(max(v) FILTER (col_no = 1)) AS text, coalesce(trim(max(v) FILTER (col_no = 3)), '') AS spec, max(v) FILTER (col_no = q) AS qty, trim(max(v) FILTER (col_no = p)) AS price, trim(max(v) FILTER (col_no = t)) AS total
  FROM v JOIN k ON k.file = v.file AND v.row_no > k.header GROUP BY k.file, v.row_no),
m AS (SELECT *, CASE WHEN contains(text, ' ') AND NOT regexp_matches(text, '^[0-9]') THEN substr(string_split(text, ' ')[1], 1, 20) WHEN length(text) > 25 THEN substr(text, 1, 20) ELSE text END AS model,
  substr(CASE WHEN contains(text, ' ') AND NOT regexp_matches(text, '^[0-9]') THEN trim(substr(text, instr(text, ' '))) ELSE text END, 1, 50) AS name FROM r WHERE text <> ''),
g AS (SELECT *, NOT regexp_matches(text, '^\\d+\\.\\s') AND NOT regexp_matches(lower(text), 'total|amount|{_WORDS}') AND length(model) >= 2 AS good FROM m),
-- rows without a description: those between header and last row that are missing in g
a AS (SELECT k.file, header, max(row_no) AS last FROM k JOIN v ON v.file = k.file GROUP BY ALL),
e AS (SELECT a.file, min(u.row_no) AS stop FROM a, unnest(range(1, last + 1)) AS u(row_no) WHERE u.row_no > a.header AND NOT EXISTS (SELECT 1 FROM g WHERE g.file = a.file AND g.row_no = u.row_no)
  AND (SELECT count(*) FROM g WHERE g.file = a.file AND g.good AND g.row_no < u.row_no) >= 2 GROUP BY a.file),
n AS (SELECT g.*, CAST(trunc(TRY_CAST(replace(qty, ',', '') AS DOUBLE)) AS BIGINT) AS n, {_price('price')} AS p, {_price('total')} AS t FROM g LEFT JOIN e ON e.file = g.file WHERE good AND (stop IS NULL OR g.row_no < stop))
SELECT file, row_no, model, name, substr(spec, 1, 500) AS spec, currency, n AS qty, round(CASE WHEN coalesce(p, 0) = 0 AND t <> 0 AND n > 0 THEN t / n ELSE p END, 4) AS unit_price, t AS total FROM n""")  # fmt: skip
def invoice_sheet_rows(c):
    from pyspark.sql import functions as F

    rows = staged_in_parts(lambda cells: I.invoice_sheet_rows(cells, last_row=None), c, "invoice-rows", "file", "sheet")
    return rows.drop("sheet").withColumn("unit_price", F.round("unit_price", 4))


#: The columns of header_mapping under other headers, over other cells.
_TABLE_COLUMNS = _MAPPED[len(_HEADERS) :].replace("FROM sheets", "FROM table_sheets")


@query("table_rows", "table_sheets", sql=f"""q1 AS (SELECT file, sheet, row_no, col_no, max(value) AS v, lower(max(value)) AS low FROM table_sheets WHERE value <> '' GROUP BY ALL),
q2 AS (SELECT file, sheet, CASE WHEN count(*) FILTER (row_no = 1 AND col_no < 10 AND {_any(T.TOP_HEADER, 'low')}) > 0 THEN 1 ELSE coalesce(min(row_no) FILTER (row_no BETWEEN 2 AND 34 AND col_no < 10 AND {_any(T.DEEP_HEADER, 'low')}), 1) END AS header, max(row_no) AS last FROM q1 GROUP BY ALL),
heads AS (SELECT file, sheet, header FROM q2)
{_TABLE_COLUMNS},
q3 AS (SELECT file, sheet, header, last, coalesce((SELECT min(row_no) FROM q1 WHERE q1.file = q2.file AND q1.sheet = q2.sheet AND q2.header > 1 AND col_no = 1 AND row_no > q2.header AND row_no < 200 AND contains(low, 'total')), least(last + 1, 2000)) AS stop FROM q2),
q4 AS (SELECT q1.file, q1.sheet, row_no, max(v) FILTER (col_no = coalesce(p.model, 2)) AS model, max(v) FILTER (col_no = coalesce(p.name, 3)) AS name, max(v) FILTER (col_no = coalesce(p.spec, 4)) AS spec, max(v) FILTER (col_no = p.price) AS price, max(v) FILTER (col_no = p.remark) AS remark,
  max(v) FILTER (col_no = p.packing) AS packing, max(v) FILTER (col_no = p.qty) AS qty FROM q1 JOIN q3 ON q3.file = q1.file AND q3.sheet = q1.sheet LEFT JOIN mapped p ON p.file = q1.file AND p.sheet = q1.sheet WHERE row_no > header AND row_no < stop GROUP BY ALL),
q5 AS (SELECT * EXCLUDE (price), {_price('trim(price)')} AS price_rmb, trim(coalesce(model, '')) AS raw, concat_ws(chr(10), spec, '[包规] ' || packing, '[起订量/数量] ' || qty) AS spec_zh FROM q4),
q6 AS (SELECT * EXCLUDE (model), CASE WHEN length(raw) >= 2 THEN substr(trim(string_split(raw, chr(10))[1]), 1, 30) ELSE raw END AS model FROM q5 WHERE length(raw) >= 2 OR price_rmb > 0),
{_ROW.replace("FROM candidates", "FROM q6")},
q7 AS (SELECT q1.file, q1.sheet, string_agg(trim(v), chr(10) ORDER BY row_no) AS footer FROM q1 JOIN q3 ON q3.file = q1.file AND q3.sheet = q1.sheet WHERE stop < last AND row_no >= stop AND row_no < stop + 30 AND col_no = 1 AND trim(v) <> '' GROUP BY ALL)
SELECT sc.file, row_no, model, coalesce(trim(name), '') AS name, spec_zh AS spec, price_rmb AS price, coalesce(nullif(trim(coalesce(remark, '')), ''), footer, '') AS remark FROM sc LEFT JOIN q7 ON q7.file = sc.file AND q7.sheet = sc.sheet WHERE score >= -1.5""")  # fmt: skip
def table_rows(c):
    return T.table_rows(c, YEAR).drop("sheet")
