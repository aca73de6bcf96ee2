"""The queries opN_<name> and pipeline, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import classify
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .language_crf import identify
from .lexical_search import search
from .line_dedup import line_dedup
from .lm_score import lm_score
from .mixing import mix_sources
from .packing import pack
from .quality_rules import quality_rules
from .token_counts import token_counts
from .url_filter import url_filter
from .vector_code import ROUNDS, compress


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary=vocabulary("piece_bpe_32k.model"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("th")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed_lines").alias("removed_lines"), "text")


def op11_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


SQL_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
q AS (
  SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0)
    / (CASE WHEN size > 0 AND length(t) BETWEEN 4 * size AND 10 * size THEN 1.0 ELSE 0.5 END
       * CASE WHEN (length(t) - length(translate(t, '#*$%&|<>', ''))) * 10 > size THEN 0.5 ELSE 1.0 END) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM q GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
b AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
x AS (SELECT q.doc_id, q.size, b.source_size, b.target, b.epochs, b.rest,
    CAST(sum(q.size) OVER (PARTITION BY q.source ORDER BY q.key, q.doc_id NULLS LAST, q.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, rest - (upto - size))) AS taken FROM x
"""

SQL_OP2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

SQL_OP10 = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS long FROM l),
e AS (SELECT *, i = n OR long OR coalesce(lead(long) OVER w, false) OR (coalesce(lag(h) OVER w, 0) * 31 + h) % 2 = 0 AS stop FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
c AS (SELECT doc_id, no, min(i) AS start, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, no),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) > 1 AS gone FROM c WHERE lines > 1 AND regexp_matches(chunk, '[^\x20\x09-\x0D]') OR len(regexp_extract_all(chunk, '[^\x20\x09-\x0D]+')) >= 50),
-- runs: from each line with a word on, and up to it, the fewest lines that make 50 words
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS BIGINT) AS begun FROM (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) WHERE n > 0),
f AS (SELECT doc_id, i AS s, max(i) OVER v AS e, string_agg(line, chr(10)) OVER v AS run, count(*) OVER v AS k, sum(n) OVER v AS ws FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY begun RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
g AS (SELECT doc_id, min(i) OVER v AS s, i AS e, string_agg(line, chr(10)) OVER v AS run, count(*) OVER v AS k, sum(n) OVER v AS ws FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
u AS (SELECT DISTINCT doc_id, s, e, run FROM (SELECT * FROM f UNION ALL SELECT * FROM g) WHERE k > 1 AND ws >= 50),
p AS (SELECT doc_id, s, e, first_value(doc_id) OVER v AS fd, first_value(s) OVER v AS fs, first_value(e) OVER v AS fe FROM u WINDOW v AS (PARTITION BY run ORDER BY doc_id, s, e)),
x AS (SELECT doc_id, CASE WHEN fd = doc_id THEN greatest(s, fe + 1) ELSE s END AS s, e FROM p WHERE (doc_id, s, e) <> (fd, fs, fe)
  UNION ALL SELECT doc_id, start, start + lines - 1 FROM r WHERE gone),
y AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN x ON x.doc_id = l.doc_id AND l.i BETWEEN x.s AND x.e)
SELECT d.doc_id, CAST(count(l.i) AS BIGINT) AS n_lines, CAST(count(y.i) AS BIGINT) AS removed_lines,
  CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (y.i IS NULL), '') END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = l.doc_id AND y.i = l.i GROUP BY d.doc_id
"""

SQL_OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g FROM w, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT k.doc_id, class_id, CAST(count(*) OVER (PARTITION BY class_id) AS BIGINT) AS class_size,
  CAST(coalesce(x.links, 0) AS BIGINT) AS n_links, CAST(coalesce(x.same, 0) + 1 AS BIGINT) AS copies
FROM k LEFT JOIN (SELECT a, count(*) AS links, count(*) FILTER (same) AS same FROM l GROUP BY a) x ON x.a = k.doc_id
"""

#: Points against their part's books: nearest entry and distance. {0} is the round before.
ASSIGNED = """
a{0} AS MATERIALIZED (SELECT vec_id, label, r, k, x, min(d) AS d, arg_min(i, d * 16 + i) AS i FROM (
  SELECT p.vec_id, p.label, p.r, p.k, p.x, b.i, list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.c[j]) * (p.x[j] - b.c[j])))::BIGINT AS d FROM p JOIN b{0} b ON p.k = b.k)
  GROUP BY ALL)"""
#: Entries become the floored means of their points; entries without points stay. {1} is the round.
AVERAGED = """,
b{1} AS MATERIALIZED (SELECT b.k, b.i, coalesce(n.c, b.c) AS c FROM b{0} b LEFT JOIN (
  SELECT k, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
    SELECT k, i, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{0}, unnest(range(1, len(x) + 1)) AS u(j) GROUP BY k, i, j) GROUP BY k, i) n ON n.k = b.k AND n.i = b.i),"""
SQL_OP11 = (
    """
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, label, r, k, e[k * (len(e) // 8) + 1 : (k + 1) * (len(e) // 8)] AS x FROM v, unnest(range(8)) AS u(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS i, x AS c FROM p WHERE r <= 16),"""
    + "".join((ASSIGNED + AVERAGED).format(k, k + 1) for k in range(ROUNDS))
    + ASSIGNED.format(ROUNDS)
    + f""",
o AS (SELECT vec_id, label, r, string_agg(format('{{:02x}}', i), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label, r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c[j]::VARCHAR, ',' ORDER BY k, i, j)) FROM b{ROUNDS}, unnest(range(1, len(c) + 1)) AS u(j)) AS codebooks_sha256 FROM o
"""
)

SQL_OP12 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
h AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM h),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM h) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), g),
m AS (SELECT r, doc_id, 100 - 90 + (90 * n * nd) // nl AS m FROM h, g),
s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 10
"""

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_code": op11_vector_code,
    "op12_lexical_search": op12_lexical_search,
    "op13_language_crf": op13_language_crf,
}
#: None for the others: learned models, token ids and hashes that SQL lacks; tests hold them against brute force.
ORACLE_SQL = {"op1_source_mix": SQL_OP1, "op2_exact_dedup": SQL_OP2, "op8_jaccard_join": SQL_OP8, "op10_line_dedup": SQL_OP10, "op11_vector_code": SQL_OP11, "op12_lexical_search": SQL_OP12}
