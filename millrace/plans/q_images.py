"""Images of products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as I
from .registry import query

_KW = """kw AS (SELECT DISTINCT id, unnest(list_filter([lower(model), regexp_replace(lower(model), '[^a-z0-9]', '', 'g')] || list_filter(regexp_extract_all(lower(model), '\\d+') || regexp_extract_all(lower(model), '[a-z]+') || string_split_regex(lower(model), '[-_\\s]+'), lambda x: length(x) >= 3), lambda x: x <> '')) AS word, file FROM pictured),
im AS (SELECT *, substr(path, 8) AS name, regexp_replace(substr(path, 8), '\\.[^.]*$', '') AS s FROM images)"""
_NAME = _KW + ", ex AS (SELECT id, min(path) AS path FROM kw JOIN im ON im.s = kw.word GROUP BY id), co AS (SELECT id, min(path) AS path FROM kw JOIN im ON contains(im.name, kw.word) WHERE length(word) >= 3 AND id NOT IN (SELECT id FROM ex) GROUP BY id)"


@query("image_match_name", "pictured", "images", sql=_NAME + " SELECT * FROM ex UNION ALL SELECT * FROM co")
def image_match_name(p, i):
    return I.match_by_name(p, i)


@query("image_match_scored", "pictured", "images", sql="""im AS (SELECT *, regexp_replace(substr(path, 8), '\\.[^.]*$', '') AS s FROM images), p AS (SELECT id, lower(model) AS m FROM pictured),
x AS (SELECT id, path, idx, 3 AS score FROM p JOIN im ON s = m UNION ALL SELECT id, path, idx, 2 FROM p JOIN im ON (contains(s, m) AND m <> '') OR (contains(m, s) AND s <> '')
  UNION ALL SELECT id, path, idx, 1 FROM (SELECT id, unnest(list_filter(string_split(m, '-'), lambda x: x <> '')) AS part FROM p) JOIN im ON contains(s, part))
SELECT id, arg_max(path, score * 10000000 - idx) AS path, max(score) AS score FROM x GROUP BY id""")  # fmt: skip
def image_match_scored(p, i):
    return I.match_scored(p, i)


@query("image_match_source", "pictured", "images", sql=_KW + """,
ow AS (SELECT id, min(path) AS path FROM kw JOIN im ON im.file = kw.file AND contains(im.name, kw.word) WHERE length(word) >= 3 GROUP BY id),
po AS (SELECT id, min(path) AS path FROM kw JOIN im ON contains(im.name, kw.word) WHERE length(word) >= 3 AND kw.file NOT IN (SELECT file FROM images) GROUP BY id)
SELECT * FROM ow UNION ALL SELECT * FROM po""")  # fmt: skip
def image_match_source(p, i):
    return I.match_in_source(p, i)


_SOURCES = "SELECT id, CASE WHEN id % 13 = 0 THEN substr(model, 1, 2) ELSE model END AS model, CASE id % 5 WHEN 0 THEN 'none.xlsx' WHEN 1 THEN upper(file) || '_ x.pdf' ELSE 'F-' || substr(file, 2) || '.xlsx' END AS source_file FROM {0}"
_FOLDERS = "SELECT path, CASE WHEN idx % 3 = 0 THEN file ELSE 'of ' || file END AS folder FROM {0}"


@query("image_match_folder", "pictured", "images", sql=f"""p AS (SELECT id, trim(lower(model)) AS model, translate(lower(regexp_replace(source_file, '\\.[^.]*$', '')), '_- ', '') AS key FROM ({_SOURCES.format('pictured')}) WHERE trim(model) <> ''),
i AS (SELECT path, folder, translate(lower(folder), '_- ', '') AS fkey, lower(regexp_replace(substr(path, 8), '\\.[^.]*$', '')) AS name FROM ({_FOLDERS.format('images')})),
f AS (SELECT k.key, arg_min(folder, (k.key <> fkey, folder)) AS at FROM (SELECT DISTINCT key FROM p) k JOIN (SELECT DISTINCT folder, fkey FROM i) x ON contains(fkey, k.key) OR contains(k.key, fkey) GROUP BY k.key)
SELECT p.id, min(i.path) AS path FROM p LEFT JOIN f USING (key) JOIN i ON (f.at IS NULL OR i.folder = f.at) AND (contains(i.name, p.model) OR contains(p.model, i.name)) GROUP BY p.id""")  # fmt: skip
def image_match_folder(p, i):
    return I.match_in_folder(p.sparkSession.sql(_SOURCES.format("{p}"), p=p), i.sparkSession.sql(_FOLDERS.format("{i}"), i=i))


@query("image_match_row", "pictured", "images", sql="""im AS (SELECT file, sheet, row_no, min(path) AS path FROM images GROUP BY ALL),
b AS (SELECT p.id, arg_min(im.path, (im.row_no <> p.row_no, im.sheet, CASE im.row_no - p.row_no WHEN 0 THEN 0 WHEN -2 THEN 1 WHEN -1 THEN 2 WHEN 1 THEN 3 ELSE 4 END)) AS path FROM pictured p JOIN im ON im.file = p.file AND im.row_no BETWEEN p.row_no - 2 AND p.row_no + 2
  AND (contains(trim(lower(im.sheet)), trim(lower(p.sheet))) OR contains(trim(lower(p.sheet)), trim(lower(im.sheet)))) GROUP BY p.id),
n AS (SELECT id, file, row_number() OVER (PARTITION BY file ORDER BY sheet, row_no, id) AS k FROM pictured), k AS (SELECT file, path, row_number() OVER (PARTITION BY file ORDER BY sheet, row_no, idx) AS k FROM images)
SELECT * FROM b UNION ALL SELECT n.id, k.path FROM n JOIN k ON k.file = n.file AND k.k = n.k WHERE n.id NOT IN (SELECT id FROM b)""")  # fmt: skip
def image_match_row(p, i):
    return I.match_by_row(p, i)


@query("image_match_page", "pictured", "images", sql="""p AS (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY id) AS i FROM pictured), m AS (SELECT file, page, path, row_number() OVER (PARTITION BY file, page ORDER BY y, idx) AS i FROM images),
j AS (SELECT p.*, m.path, CASE WHEN lag(model) OVER (PARTITION BY p.file, p.page ORDER BY id) = model THEN 0 ELSE 1 END AS new FROM p LEFT JOIN m ON m.file = p.file AND m.page = p.page AND m.i = p.i),
r AS (SELECT *, sum(new) OVER (PARTITION BY file, page ORDER BY id) AS run FROM j)
SELECT id, path FROM (SELECT id, last_value(path IGNORE NULLS) OVER (PARTITION BY file, page, run ORDER BY id) AS path FROM r) WHERE path IS NOT NULL""")  # fmt: skip
def image_match_page(p, i):
    return I.match_by_page(p, i)


@query("image_union", "images", sql="x AS (SELECT DISTINCT file, sheet, row_no, path FROM images UNION SELECT file, sheet, row_no, 'b' || path FROM images WHERE idx % 3 = 0) SELECT file, sheet, row_no, string_agg(path, '||' ORDER BY path) AS paths FROM x GROUP BY ALL")
def image_union(i):
    a = i.select("file", "sheet", "row_no", F.col("path").alias("paths"))
    b = i.where("idx % 3 = 0").select("file", "sheet", "row_no", F.concat("path", F.lit("||b"), "path").alias("paths"))
    return I.image_union(a, b)
