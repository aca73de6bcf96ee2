"""Scores, coverage, accuracy of extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as M
from ..operators import quality as Q
from .registry import query

C = F.col
YEAR = 2024
_WORDS = "|".join(sorted({*M.FIELD_NAMES, *M.TERM_WORDS}))
_ROW = f"""a AS (SELECT *, trim(model) AS m, coalesce(price_rmb >= 0.01 AND price_rmb < 10000000 AND NOT (price_rmb BETWEEN 2021 AND 2029 AND price_rmb = floor(price_rmb)), false) AS priced,
  length(trim(spec_zh)) > 15 OR regexp_matches(lower(spec_zh), '\\d+\\.?\\d*\\s*(mm|cm|m|kg|g|w|v|a|hz|℃|°|%)') AS specified, regexp_matches(lower(trim(model)), '\\b({_WORDS})\\b') AS field FROM candidates),
r AS (SELECT *, length(m) BETWEEN 2 AND 30 AND NOT contains(m, ':') AND NOT field AND (regexp_matches(m, '\\d') OR (priced AND length(m) <= 12)) AS isreal, length(m) < 2 AS empty FROM a),
sc AS (SELECT *, CASE WHEN isreal AND priced AND specified THEN 7.0 WHEN isreal AND priced THEN 5.0 WHEN isreal AND specified THEN 4.0 WHEN isreal THEN 2.0 WHEN NOT empty AND field THEN -1.0 WHEN NOT empty THEN 1.0 WHEN empty AND NOT priced THEN -3.0 ELSE 0.0 END::DOUBLE AS score,
  CASE WHEN length(m) BETWEEN 2 AND 40 AND NOT contains(m, ':') AND NOT field AND NOT regexp_matches(lower(m), '(\\d+\\.?\\d*\\s*mm|\\d+\\.?\\d*\\s*cm|\\d+v\\b|\\d+w\\b)') AND (regexp_matches(m, '\\d') OR (regexp_matches(m, '[A-Za-z]') AND length(m) <= 12)) THEN m END AS vm FROM r)"""
_FRAME = """{0} AS (SELECT {1}, count(*) AS count, count(*) FILTER (score >= 5) AS real_models, count(*) FILTER (score >= 5 AND price_rmb > 0) AS prices, round(round(avg(score), 1) + (CASE WHEN count(DISTINCT vm) >= 3 THEN 3 ELSE 0 END + CASE WHEN count(*) FILTER (score >= 5 AND price_rmb > 0) >= 3 THEN 2 ELSE 0 END
  + CASE WHEN count(*) FILTER (score <= -2) / count(*) < 0.2 AND count(*) >= 3 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS score FROM sc GROUP BY ALL)"""


@query("score_row", "candidates", sql=_ROW + " SELECT row_no, score FROM sc")
def score_row(c):
    return Q.with_score(c, YEAR).select("row_no", "score")


@query("score_frame", "candidates", sql=_ROW + ", " + _FRAME.format("fr", "file") + " SELECT file, count, real_models, prices, score FROM fr")
def score_frame(c):
    return Q.score_frame(c, ["file"], YEAR)


_RES = "rs AS (SELECT {0}, round(count(*) * 0.3::DOUBLE + count(*) FILTER (length(trim(model)) > 1) * 0.3::DOUBLE + count(*) FILTER (price_rmb > 0) * 0.2::DOUBLE + count(DISTINCT CASE WHEN model <> '' THEN lower(trim(model)) END) / greatest(count(*) FILTER (length(trim(model)) > 1), 1)::DOUBLE * 2, 6) AS score FROM candidates GROUP BY ALL)"


@query("score_result", "candidates", sql=_RES.format("file, parser") + " SELECT file, parser, score FROM rs")
def score_result(c):
    return Q.score_result(c, ["file", "parser"])


@query("parser_winner", "candidates", sql=_ROW + ", " + _FRAME.format("fr", "file, parser") + ", gd AS (SELECT file, parser, count(*) FILTER (score > 0) AS good FROM sc GROUP BY ALL) SELECT file, parser, good, score FROM gd JOIN fr USING (file, parser) QUALIFY row_number() OVER (PARTITION BY file ORDER BY good DESC, score DESC, parser) = 1")
def parser_winner(c):
    return Q.parser_winner(c, YEAR)


@query("candidate_winner", "candidates", sql="""c AS (SELECT row_no % 50 AS tab, CASE row_no % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'rows' ELSE 'columns' END AS strategy, model, price_rmb FROM candidates),
s AS (SELECT tab, strategy, round(count(*) * 0.3::DOUBLE + count(*) FILTER (length(trim(model)) > 1) * 0.3::DOUBLE + count(*) FILTER (price_rmb > 0) * 0.2::DOUBLE + count(DISTINCT CASE WHEN model <> '' THEN lower(trim(model)) END) / greatest(count(*) FILTER (length(trim(model)) > 1), 1)::DOUBLE * 2, 6) AS score FROM c GROUP BY ALL),
g AS (SELECT tab, first(strategy ORDER BY score DESC, strategy DESC) FILTER (strategy <> 'content') AS layout, max(score) FILTER (strategy <> 'content') AS ls, max(score) FILTER (strategy = 'content') AS cs FROM s GROUP BY tab)
SELECT tab, CASE WHEN layout IS NULL OR cs > 1.5 * ls THEN 'content' ELSE layout END AS winner FROM g""")  # fmt: skip
def candidate_winner(c):
    d = c.select((C("row_no") % 50).alias("tab"), F.when(C("row_no") % 3 == 0, "content").when(C("row_no") % 3 == 1, "rows").otherwise("columns").alias("strategy"), "model", "price_rmb")
    return Q.candidate_winner(d, "tab", "strategy", "content")


@query("coverage", "candidates", sql="SELECT file, round((count(*) FILTER (model <> '') + count(*) FILTER (name_zh <> '') + count(price_rmb)) / (count(*) * 3)::DOUBLE, 6) AS coverage FROM candidates GROUP BY 1")
def coverage(c):
    return Q.coverage(c, "file", ["model", "name_zh", "price_rmb"])


@query("price_coverage", "candidates", sql="SELECT file, round(count(price_rmb) / count(*)::DOUBLE, 6) AS share FROM candidates GROUP BY 1")
def price_coverage(c):
    return c.groupBy("file").agg(F.round(F.count("price_rmb") / F.count(F.lit(1)), 6).alias("share"))


@query("default_currency", "candidates", sql="SELECT row_no, CASE WHEN max(currency) OVER w <> '' THEN currency WHEN avg(CASE WHEN price_rmb > 0 THEN price_rmb END) OVER w > 500 THEN 'USD' ELSE 'CNY' END AS currency FROM candidates WINDOW w AS (PARTITION BY file)")
def default_currency(c):
    return Q.default_currency(c, "file").select("row_no", "currency")


@query("eval_accuracy", "expected", "parsed", sql="""f AS (SELECT *, lower(trim(model)) AS mk FROM parsed QUALIFY row_number() OVER (PARTITION BY file, lower(trim(model)) ORDER BY row_no) = 1),
j AS (SELECT e.*, f.mk, f.price_rmb AS got, f.name_zh AS gn, f.spec_zh AS gs FROM expected e LEFT JOIN f ON f.file = e.file AND f.mk = lower(trim(e.model))),
g AS (SELECT file, count(*) AS expected, avg(CASE WHEN mk IS NOT NULL THEN 1.0 ELSE 0 END) AS model, avg(CASE WHEN abs(got - price_rmb) <= price_rmb * tolerance / 100 THEN 1.0 ELSE 0 END) AS price, avg(CASE WHEN contains(gn, name_keyword) THEN 1.0 ELSE 0 END) AS name, avg(CASE WHEN contains(gs, spec_keyword) THEN 1.0 ELSE 0 END) AS spec FROM j GROUP BY file),
h AS (SELECT g.*, CASE WHEN n = expected THEN 1.0 WHEN abs(n - expected) <= expected THEN 0.5 ELSE 0 END::DOUBLE AS count_score FROM g JOIN (SELECT file, count(*) AS n FROM parsed GROUP BY 1) USING (file)),
s AS (SELECT *, round(count_score * 0.35::DOUBLE + model * 0.30::DOUBLE + price * 0.15::DOUBLE + name * 0.15::DOUBLE + spec * 0.05::DOUBLE, 2) AS score FROM h)
SELECT file, count_score, round(model, 4) AS model, round(price, 4) AS price, round(name, 4) AS name, round(spec, 4) AS spec, score, score >= 0.75 AS passes FROM s""")  # fmt: skip
def eval_accuracy(e, p):
    return Q.eval_accuracy(e, p)


@query("is_header_like", "cells", sql="SELECT file, row_no, col_no, value <> '' AND (regexp_matches(lower(value), 'image|photo|picture|serial') OR length(value) > 30) AS header_like FROM cells")
def is_header_like(c):
    v = F.lower(F.coalesce("value", F.lit("")))
    return c.select("file", "row_no", "col_no", ((v != "") & (v.rlike("image|photo|picture|serial") | (F.length("value") > 30))).alias("header_like"))
