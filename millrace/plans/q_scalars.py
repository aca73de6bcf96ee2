"""Texts of specifications, models, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as G
from ..functions import models as M
from ..functions import specs as S
from ..functions.prices import let, rounded
from .registry import query

C = F.col
_STRIP = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"


def spread(t: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's shuffle tasks, before work on texts that costs far more than to move them: a
    file of short rows is one task's input, however many rows it holds."""
    return t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _map_rows(t: DataFrame, m: Column) -> DataFrame:
    """id, the map's entries as one text and their number, for rows whose map has entries. The map is made once: a filter
    and columns on it would each make it anew."""

    def row(m: Column) -> Column:
        pairs = F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
        return F.when(F.size(m) > 0, F.array(F.struct(pairs.alias("pairs"), F.size(m).alias("n"))))

    return t.select("id", F.inline(let(m, row)))


def _cleaned(source: str, text: str) -> str:
    """CTEs that end in cleaned (id, spec): clean_spec in SQL over a text column of source."""
    return rf"""c1 AS (SELECT id, {_STRIP.format(text)} AS t FROM {source}),
c2 AS (SELECT id, t, regexp_replace(regexp_replace(replace(replace(replace(translate(t, '：；', ':;'), '::', ':'), ': :', ': '), 'Motorcycle Brand Name', 'Brand Name'), ';\s*([A-Z一-鿿])', chr(10) || '\1', 'g'), ';+$', '') AS s FROM c1),
c3 AS (SELECT id, t, s, list_filter(string_split_regex(s, '\s+'), lambda w: w <> '') AS ws FROM c2),
c4 AS (SELECT id, t, CASE WHEN contains(s, chr(10)) OR s = '' THEN s ELSE array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = 1 THEN w WHEN instr(w, ':') > 1 AND regexp_matches(w, '^\pL') AND len(list_filter(ws[1:i - 1], lambda x: instr(x, ':') > 1)) > 0 THEN chr(10) || w ELSE ' ' || w END), '') END AS s FROM c3),
c5 AS (SELECT id, t, CASE WHEN length(s) < 3 THEN s WHEN regexp_matches(s, '\d+\*\s*$') THEN CASE WHEN ends_with(s, '(尺寸单位缺失)') THEN s ELSE s || ' (尺寸单位缺失)' END WHEN regexp_matches(s, '\*\s*$|-\s+$|[:：]\s*$|,\s*$') THEN CASE WHEN ends_with(s, '(may be incomplete)') THEN s ELSE s || ' (may be incomplete)' END ELSE s END AS s FROM c4),
cleaned AS (SELECT id, CASE WHEN lower(t) IN ('', 'nan', 'none') THEN 'Standard configuration. Contact us for details.' ELSE array_to_string(list_filter(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) END AS spec FROM c5)"""


@query("clean_spec", "texts", sql=_cleaned("texts", "spec") + " SELECT id, spec FROM cleaned")
def clean_spec(t):
    return t.select("id", S.clean_spec(C("spec")).alias("spec"))


@query("fix_truncated_spec", "texts", sql="SELECT id, CASE WHEN length(spec) < 3 THEN spec WHEN regexp_matches(spec, '\\d+\\*\\s*$') THEN spec || ' (尺寸单位缺失)' WHEN regexp_matches(spec, '\\*\\s*$|-\\s+$|[:：]\\s*$|,\\s*$') THEN spec || ' (may be incomplete)' ELSE spec END AS spec FROM texts")
def fix_truncated_spec(t):
    return t.select("id", S.fix_truncated_spec(C("spec")).alias("spec"))


_UNITS = "[" + ", ".join(f"'{u.upper()}'" for u in S.UNITS) + "]"


@query("format_spec", "texts", sql=rf"""f1 AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, list_filter(list_transform(string_split(spec || chr(10) || packaging || chr(10) || model, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ls FROM texts)),
f2 AS (SELECT id, i, ls[i] AS line, string_split(regexp_replace(ls[i], '\s+([\w一-鿿]+:)', chr(1) || '\1', 'g'), chr(1)) AS parts, trim(regexp_extract(ls[i], '^([^:：]+)[:：]\s*(.+)$', 1)) AS name, trim(regexp_extract(ls[i], '^([^:：]+)[:：]\s*(.+)$', 2)) AS value, regexp_extract(ls[i], '^(\S+)', 1) AS word, regexp_extract(ls[i], '^\S+\s+(.*)$', 1) AS rest FROM f1),
f3 AS (SELECT id, i, CASE WHEN name <> '' AND value <> '' AND NOT regexp_matches(value, '[\w一-鿿]+:') THEN [name || ': ' || value]
  WHEN (name <> '' AND value <> '') OR len(parts) > 1 THEN list_filter(list_transform(parts, lambda p: CASE WHEN trim(regexp_extract(p, '^([^:：]+)[:：]\s*(.+)$', 1)) <> '' AND trim(regexp_extract(p, '^([^:：]+)[:：]\s*(.+)$', 2)) <> '' THEN trim(regexp_extract(p, '^([^:：]+)[:：]\s*(.+)$', 1)) || ': ' || trim(regexp_extract(p, '^([^:：]+)[:：]\s*(.+)$', 2)) END), lambda x: x IS NOT NULL)
  WHEN regexp_matches(line, '\d') AND len(list_filter({_UNITS}, lambda u: contains(upper(line), u))) > 0 AND NOT regexp_matches(word, '^\d') AND rest <> '' AND (length(rest) > 2 OR regexp_matches(rest, '\d')) THEN [word || ': ' || rest] ELSE [line] END AS made FROM f2),
f4 AS (SELECT t.id, coalesce(array_to_string(flatten(list(made ORDER BY i)), chr(10)), '') AS raw FROM texts t LEFT JOIN f3 ON f3.id = t.id GROUP BY t.id),
{_cleaned('f4', 'raw')} SELECT id, spec FROM cleaned""")  # fmt: skip
def format_spec(t):
    t = spread(t.select("id", F.concat_ws("\n", "spec", "packaging", "model").alias("text")))
    return t.select("id", S.format_spec(C("text")).alias("spec"))


@query("clean_spec_text", "texts", sql="SELECT id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(packaging, '\\n+', chr(10), 'g'), ' +', ' ', 'g'), '; +', ';', 'g'), ';', ';' || chr(10)), '^\\s+|\\s+$', '', 'g') AS spec FROM texts")
def clean_spec_text(t):
    return t.select("id", S.clean_spec_text(C("packaging")).alias("spec"))


@query("spec_to_map", "texts", sql=rf"""m1 AS (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT id, flatten(list_transform(string_split_regex(packaging || ';' || spec, '[;\n]'), lambda p: string_split(regexp_replace({_STRIP.format('p')}, '\s+([\w一-鿿]+:)', chr(1) || '\1', 'g'), chr(1)))) AS ps FROM texts)),
m2 AS (SELECT id, i, trim(regexp_extract(ps[i], '^([^:：]+)[:：]\s*(.+)$', 1)) AS k, trim(regexp_extract(ps[i], '^([^:：]+)[:：]\s*(.+)$', 2)) AS v FROM m1),
m3 AS (SELECT id, k, arg_max(v, i) AS v FROM m2 WHERE k <> '' AND v <> '' GROUP BY 1, 2)
SELECT id, string_agg(k || '=' || v, '|' ORDER BY k) AS pairs, count(*) AS n FROM m3 GROUP BY id""")  # fmt: skip
def spec_to_map(t):
    return _map_rows(spread(t.select("id", F.concat_ws(";", "packaging", "spec").alias("text"))), S.spec_to_map(C("text")))


@query("map_to_spec", "texts", sql="SELECT id, 'size: ' || s || '; kind: ' || kind AS spec FROM texts")
def map_to_spec(t):
    return t.select("id", S.map_to_spec(F.create_map(F.lit("size"), C("s").cast("string"), F.lit("kind"), C("kind"))).alias("spec"))


@query("parse_spec_dict", "texts", sql=rf"""p1 AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, list_transform(string_split(regexp_replace(translate(fields, '：（）－＂＇', ':()-"' || chr(39)), '\r\n?', chr(10), 'g'), chr(10)), lambda x: {_STRIP.format('x')}) AS ls FROM texts)),
p2 AS (SELECT id, i, ls[i] AS line, CASE WHEN instr(ls[i], ':') > 0 THEN instr(ls[i], ':') ELSE instr(ls[i], '-') END AS cut FROM p1 WHERE regexp_matches(ls[i], '[:-]')),
p3 AS (SELECT id, i, trim(substr(line, 1, cut - 1)) AS k, trim(substr(line, cut + 1)) AS v FROM p2),
p4 AS (SELECT id, k, arg_max(v, i) AS v FROM p3 WHERE k <> '' AND lower(k) NOT IN ('型号', 'model', '价格', 'price', 'name', '名称') GROUP BY 1, 2)
SELECT id, string_agg(k || '=' || v, '|' ORDER BY k) AS pairs, count(*) AS n FROM p4 GROUP BY id""")  # fmt: skip
def parse_spec_dict(t):
    return _map_rows(spread(t.select("id", "fields")), S.parse_spec_dict(C("fields")))


@query("serialize_specs", "texts", sql="SELECT id, concat_ws(chr(10), '尺寸: ' || s, 'HTML: ' || nullif(html, ''), CASE WHEN number_text <> '' THEN 'No: ' || number_text END) AS spec FROM texts")
def serialize_specs(t):
    return t.select("id", S.serialize_specs({"s": "尺寸", "html": "HTML", "number_text": "No"}).alias("spec"))


def _sized() -> str:
    """The first pattern that fits and its groups, in SQL: sizes in mm by unit."""
    quoted = {n: getattr(S, n).replace("'", "''") for n in ("LWH", "DIA", "LABEL", "FLAT")}
    group = lambda n, i: f"nullif(regexp_extract(t, '{quoted[n]}', {i}), '')"
    unit = {n: "lower(coalesce(" + ", ".join(group(n, i) for i in gs) + "))" for n, gs in (("LWH", (2, 6)), ("DIA", (2, 4)), ("LABEL", (2, 4, 6)), ("FLAT", (2, 4)))}
    places = {"length": {"LWH": 1, "LABEL": 1, "FLAT": 1}, "width": {"LWH": 3, "LABEL": 3, "FLAT": 3}, "height": {"LWH": 5, "DIA": 3, "LABEL": 5}, "diameter": {"DIA": 1}}
    fits = "CASE " + " ".join(f"WHEN regexp_matches(t, '{quoted[n]}') THEN '{n}'" for n in quoted) + " END"
    units = "CASE fit " + " ".join(f"WHEN '{n}' THEN {u}" for n, u in unit.items()) + " END"
    values = ", ".join("CASE fit " + " ".join(f"WHEN '{n}' THEN TRY_CAST({group(n, i)} AS DOUBLE)" for n, i in by.items()) + f" END AS {name}" for name, by in places.items())
    mm = ", ".join(f"round({name} * CASE unit WHEN 'cm' THEN 10.0::DOUBLE WHEN 'inch' THEN 25.4::DOUBLE ELSE 1.0::DOUBLE END + 1e-9, 1) AS {name}" for name in places)
    known = "CASE WHEN fit IS NULL THEN NULL WHEN u IN ('cm', 'c') THEN 'cm' WHEN u IN ('inch', 'in', '\"', chr(39) || chr(39)) THEN 'inch' WHEN u IN ('m', 'mm') THEN 'mm' ELSE coalesce(u, 'mm') END"
    return f"""d1 AS (SELECT id, {_STRIP.format('dims')} AS t FROM texts), d2 AS (SELECT *, {fits} AS fit FROM d1), d3 AS (SELECT *, {units} AS u, {values} FROM d2), d4 AS (SELECT *, {known} AS unit FROM d3)
SELECT id, {mm}, unit FROM d4"""


@query("extract_dimensions", "texts", sql=_sized())
def extract_dimensions(t):
    return t.withColumn("d", S.extract_dimensions(C("dims"))).select("id", "d.length", "d.width", "d.height", "d.diameter", "d.unit")


def _packed(name: str, value: str = "v", usable: str = "true") -> str:
    """The last value of a packaging field, in SQL over pairs (k, v)."""
    return f"list_filter(pairs, lambda p: len(list_filter({list(S.PACKAGING[name])}, lambda w: contains(p.k, w))) > 0 AND ({usable}))[-1].v"


_NUMBER = "TRY_CAST(nullif(regexp_replace({0}, '[^\\d.]', '', 'g'), '') AS DOUBLE)"
_WHOLE = "TRY_CAST(nullif(regexp_replace({0}, '[^\\d]', '', 'g'), '') AS INT)"


@query("packaging_fields", "texts", sql=f"""k1 AS (SELECT id, list_transform(list_filter(list_transform(string_split_regex(packaging, '[;\\n]'), lambda p: {_STRIP.format('p')}), lambda p: contains(p, ':')), lambda p: {{'k': lower(trim(substr(p, 1, instr(p, ':') - 1))), 'v': trim(substr(p, instr(p, ':') + 1))}}) AS pairs FROM texts)
SELECT id, coalesce({_packed('carton_size')}, '') AS carton_size, coalesce({_NUMBER.format(_packed('gross_weight', usable=_NUMBER.format('p.v') + ' IS NOT NULL'))}, 0) AS gross_weight, coalesce({_NUMBER.format(_packed('net_weight', usable=_NUMBER.format('p.v') + ' IS NOT NULL'))}, 0) AS net_weight,
  coalesce({_NUMBER.format(_packed('cbm', usable=_NUMBER.format('p.v') + ' IS NOT NULL'))}, 0) AS cbm, coalesce({_WHOLE.format(_packed('units_per_carton', usable=_WHOLE.format('p.v') + ' IS NOT NULL'))}, 0) AS units_per_carton, coalesce({_packed('packing_type')}, '') AS packing_type FROM k1""")  # fmt: skip
def packaging_fields(t):
    return t.withColumn("p", S.packaging_fields(C("packaging"))).select("id", "p.*")


@query("product_key", "texts", sql="SELECT id, substr(md5(concat_ws('|', nullif(" + _STRIP.format("model") + ", ''), 'Motor=' || s, CASE WHEN number_text <> '' THEN number_text END)), 1, 12) AS product_key FROM texts")
def product_key(t):
    return t.select("id", M.product_key(C("model"), F.concat(F.lit("Motor="), C("s").cast("string")), C("number_text")).alias("product_key"))


@query("normalize_model", "texts", sql="SELECT id, regexp_replace(CASE WHEN starts_with(lower(model), 'model') THEN substr(lower(model), 6) ELSE lower(model) END, '[^a-z0-9]', '', 'g') AS model FROM texts")
def normalize_model(t):
    return t.select("id", M.normalize_model(C("model")).alias("model"))


@query("model_keywords", "texts", sql="""k AS (SELECT id, lower(model) AS m FROM texts),
w AS (SELECT id, unnest(list_distinct(list_filter([m, regexp_replace(m, '[^a-z0-9]', '', 'g')] || list_filter(regexp_extract_all(m, '\\d+') || regexp_extract_all(m, '[a-z]+') || string_split_regex(m, '[-_\\s]+'), lambda x: length(x) >= 3), lambda x: x <> ''))) AS word FROM k)
SELECT id, word FROM w""")  # fmt: skip
def model_keywords(t):
    return t.select("id", F.explode(M.model_keywords(C("model"))).alias("word"))


@query("clean_sku", "texts", sql="SELECT id, trim(CASE WHEN instr(x, ':') BETWEEN 2 AND 20 THEN substr(x, 1, instr(x, ':') - 1) ELSE x END) AS sku FROM (SELECT id, string_split(string_split(model, chr(10))[1], ';')[1] AS x FROM texts)")
def clean_sku(t):
    return t.select("id", M.clean_sku(C("model")).alias("sku"))


@query("repair_model", "texts", sql="SELECT id, CASE WHEN model <> '' AND ((name <> '' AND (length(model) > length(name) * 3 OR regexp_matches(model, '^\\d+$'))) OR starts_with(model, '=')) THEN name ELSE model END AS model FROM texts")
def repair_model(t):
    return t.select("id", M.repair_model(C("model"), C("name")).alias("model"))


@query("model_from_spec", "texts", sql="SELECT id, coalesce(nullif(regexp_extract(model, '^([A-Z]{1,3}[\\-\\d]+)', 1), ''), nullif(regexp_extract(model, '^([A-Z]\\d{3,})', 1), '')) AS model FROM texts")
def model_from_spec(t):
    return t.select("id", M.model_from_spec(C("model")).alias("model"))


@query("display_name", "texts", sql="SELECT id, CASE WHEN model = name THEN model ELSE model || chr(10) || name END AS shown FROM texts")
def display_name(t):
    return t.select("id", M.display_name(C("model"), C("name")).alias("shown"))


_WORDS = "|".join(sorted({*M.FIELD_NAMES, *M.TERM_WORDS}))
_FIELD = f"regexp_matches(lower({{0}}), '\\b({_WORDS})\\b')"
_VALID = f"length({{0}}) BETWEEN 2 AND 40 AND NOT contains({{0}}, ':') AND NOT {_FIELD} AND NOT regexp_matches(lower({{0}}), '(\\d+\\.?\\d*\\s*mm|\\d+\\.?\\d*\\s*cm|\\d+v\\b|\\d+w\\b)')"


@query("is_valid_model", "texts", sql=f"SELECT id, {_VALID.format('model')} AND regexp_matches(model, '[A-Za-z]') AND regexp_matches(model, '\\d') AS strict, {_VALID.format('model')} AND (regexp_matches(model, '\\d') OR (regexp_matches(model, '[A-Za-z]') AND length(model) <= 12)) AS lax FROM texts")
def is_valid_model(t):
    return t.select("id", M.is_valid_model(C("model")).alias("strict"), M.is_valid_model(C("model"), strict=False).alias("lax"))


@query("valid_pdf_model", "texts", sql="""SELECT id, length(model) BETWEEN 2 AND 40 AND NOT regexp_matches(lower(model), ':|\\d+\\s*mm|usd$|\\d+usd|^\\d+\\.\\d+|motor|battery|weight|speed|power|voltage|current|controller|charger|description|photo|picture|material|dimension')
  AND (regexp_matches(model, '\\d') OR len(list_filter(string_split_regex(replace(model, '-', ' '), '\\s+'), lambda x: x <> '')) >= 2 OR length(model) >= 5) AS ok FROM texts""")  # fmt: skip
def valid_pdf_model(t):
    return t.select("id", M.valid_pdf_model(C("model")).alias("ok"))


@query("detect_column_kind", "cells", sql="SELECT file, col_no, CASE WHEN value LIKE '%rice%' THEN 'price' WHEN value LIKE '%pec%' THEN 'spec' WHEN value LIKE '%ame%' THEN 'name' ELSE 'model' END AS kind FROM cells WHERE row_no = 3")
def detect_column_kind(c):
    from ..operators.grid import column_kind

    return c.where("row_no = 3").select("file", "col_no", column_kind(C("value")).alias("kind"))


@query("sanitize_products", "texts", sql="SELECT id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, CASE number_text WHEN '12.5' THEN 12.5 WHEN 'abc' THEN 0 WHEN '7' THEN 7 END::DOUBLE AS number FROM texts")
def sanitize_products(t):
    return t.select("id", G.escape_html(C("html")).alias("html"), G.sanitized_number(C("number_text")).alias("number"))


_LINES = "list_filter(list_transform(string_split(zh, chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '' AND {0} regexp_matches(x, '[一-鿿]'))"


@query("filter_by_lang", "texts", sql=f"SELECT id, array_to_string({_LINES.format('')}, chr(10)) AS chinese, array_to_string({_LINES.format('NOT')}, chr(10)) AS english FROM texts")
def filter_by_lang(t):
    return t.select("id", G.lines_of(C("zh"), True).alias("chinese"), G.lines_of(C("zh"), False).alias("english"))


@query("is_mostly_english", "texts", sql="x AS (SELECT id, t, length(replace(t, ' ', '')) AS n, length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS cjk FROM (SELECT id, unnest([zh, zh || name, html]) AS t, unnest([0, 1, 2]) AS part FROM texts)) SELECT id, sum(CASE WHEN coalesce(t, '') = '' THEN 0 WHEN n = 0 THEN 1 WHEN cjk / n::DOUBLE < 0.2 THEN 1 ELSE 0 END)::BIGINT AS english FROM x GROUP BY id")
def is_mostly_english(t):
    """How many of three texts of a row are."""
    one = lambda c: G.is_mostly_english(c).cast("long")
    return t.select("id", (one(C("zh")) + one(F.concat("zh", "name")) + one(C("html"))).alias("english"))


_TERMS = "(?is)^(.*?)(?:Terms?\\s*of\\s*payment|Payment\\s*Terms?)\\s*:(.*)$"


@query("payment_by_lang", "texts", sql=f"SELECT id, CASE WHEN regexp_matches(pay, '{_TERMS}') THEN trim(regexp_extract(pay, '{_TERMS}', 1)) ELSE pay END AS zh, CASE WHEN regexp_matches(pay, '{_TERMS}') THEN 'Terms of payment: ' || trim(regexp_extract(pay, '{_TERMS}', 2)) ELSE pay END AS en FROM texts")
def payment_by_lang(t):
    return t.select("id", G.payment_by_lang(C("pay"), "chinese").alias("zh"), G.payment_by_lang(C("pay"), "english").alias("en"))


_SEPARATOR = "CASE WHEN contains({0}, '<br>') THEN '<br>' WHEN contains({0}, '/') THEN '/' WHEN contains({0}, '；') THEN '；' WHEN contains({0}, ';') THEN ';' ELSE chr(1) END"


@query("split_bilingual", "texts", sql=f"x AS (SELECT id, trim(pair) AS t FROM texts) SELECT id, trim(string_split(t, {_SEPARATOR.format('t')})[1]) AS zh, trim(string_split(t, {_SEPARATOR.format('t')})[-1]) AS en FROM x")
def split_bilingual(t):
    return t.select("id", G.split_bilingual(C("pair")).alias("zh"), G.split_bilingual(C("pair"), "en").alias("en"))


@query("clean_column_name", "texts", sql=f"x AS (SELECT id, trim(head) AS t FROM texts) SELECT id, trim(regexp_replace(regexp_replace(trim(string_split(t, {_SEPARATOR.format('t')})[1]), '(?i)\\((CNY|RMB|USD|\\$|未含电池|含电池|不含电池|kW|W|V|A|kg|L|mm)\\)', '', 'g'), '\\s+', ' ', 'g')) AS name, trim(regexp_replace(regexp_replace(trim(string_split(t, {_SEPARATOR.format('t')})[-1]), '(?i)\\((CNY|RMB|USD|\\$|未含电池|含电池|不含电池|kW|W|V|A|kg|L|mm)\\)', '', 'g'), '\\s+', ' ', 'g')) AS en FROM x")
def clean_column_name(t):
    return t.select("id", G.clean_column_name(C("head")).alias("name"), G.clean_column_name(C("head"), "en").alias("en"))


@query("fix_fullwidth", "texts", sql="SELECT id, CASE WHEN length(wide) < 2 THEN wide ELSE replace(replace(replace(replace(replace(replace(wide, '：', ':'), '（', '('), '）', ')'), '－', '-'), '＂', '\"'), '＇', chr(39)) END AS text FROM texts")
def fix_fullwidth(t):
    return t.select("id", G.fix_fullwidth(C("wide")).alias("text"))


#: A code among the words shows what protection does.
_DICTIONARY = G.WORDS | {"ABC": "alphabet"}


def _replaced(expression: str) -> str:
    for old, new in G.longest_first(_DICTIONARY):
        expression = f"replace({expression}, '{old}', '{new}')"
    return expression


@query("translate_text", "zh_texts", sql=f"SELECT id, {_replaced('zh')} AS en FROM zh_texts")
def translate_text(t):
    return G.translate_column(t, "zh", "en", _DICTIONARY).select("id", "en")


# A code next to a Chinese sign is none; an underscore on either side of the signs makes RE2's word boundaries say so.
_BARE = "regexp_replace(p, '_([一-鿿])_', '\\1', 'g')"


@query("translate_protected", "zh_texts", sql=f"""m AS (SELECT id, regexp_replace(zh, '([一-鿿])', '_\\1_', 'g') AS zh FROM zh_texts),
b AS (SELECT id, string_split_regex(zh, '\\b[A-Z]{{2,5}}\\d*\\b') AS parts, regexp_extract_all(zh, '\\b[A-Z]{{2,5}}\\d*\\b') AS codes FROM m),
p AS (SELECT id, i, {_BARE} AS p, coalesce(codes[i], '') AS code FROM (SELECT id, codes, i, parts[i] AS p FROM b, unnest(range(1, len(parts) + 1)) AS u(i)))
SELECT id, string_agg({_replaced('p')} || code, '' ORDER BY i) AS en FROM p GROUP BY id""")  # fmt: skip
def translate_protected(t):
    return G.translate_column(t, "zh", "en", _DICTIONARY, protect=True).select("id", "en")


@query("translate_frame", "zh_texts", sql=f"SELECT id, {_replaced('zh')} AS \"Color\", kind, s FROM zh_texts")
def translate_frame(t):
    return G.translate_frame(t.select("id", C("zh").alias("颜色"), "kind", "s"), _DICTIONARY)


@query("bilingual_text", "texts", sql="SELECT id, CASE WHEN id % 3 = 0 THEN name ELSE kind || ' / ' || name END AS text FROM texts")
def bilingual_text(t):
    return t.select("id", G.bilingual_text(F.when(C("id") % 3 == 0, C("name")).otherwise(C("kind")), C("name")).alias("text"))


def _words(n: str) -> str:
    """A number below 1000 in words, in SQL."""
    ones, tens = str(G.ONES), str(G.TENS)
    small = f"CASE WHEN {n} % 100 >= 20 THEN concat_ws(' ', {tens}[{n} % 100 // 10 + 1], nullif({ones}[{n} % 10 + 1], '')) ELSE {ones}[{n} % 100 + 1] END"
    return f"concat_ws(' ', CASE WHEN {n} >= 100 THEN {ones}[{n} // 100 + 1] || ' HUNDRED' END, nullif({small}, ''))"


@query("amount_in_words", "texts", sql=f"""a AS (SELECT id, round(price * id + 1e-9, 2) AS x FROM texts), b AS (SELECT id, x, CAST(floor(x) AS BIGINT) AS w, CAST(round((x - floor(x)) * 100) AS INT) AS c FROM a),
d AS (SELECT *, w // 1000000 AS m, w % 1000000 // 1000 AS t, w % 1000 AS r FROM b)
SELECT id, CASE WHEN x = 0 THEN 'ZERO USD' ELSE concat_ws(' ', CASE WHEN m > 0 THEN {_words('m')} || ' MILLION' END, CASE WHEN t > 0 THEN {_words('t')} || ' THOUSAND' END, CASE WHEN r > 0 THEN {_words('r')} END) || CASE WHEN c > 0 THEN ' AND CENTS ' || lpad(CAST(c AS VARCHAR), 2, '0') || '/100' ELSE '' END || ' USD ONLY.' END AS words FROM d""")  # fmt: skip
def amount_in_words(t):
    return t.select("id", G.amount_in_words(rounded(C("price") * C("id"), 2)).alias("words"))
