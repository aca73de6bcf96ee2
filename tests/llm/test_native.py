"""Source mix, exact dedup and line dedup: SQL on small tables, edge cases, forced hash clashes."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import registry
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.line_dedup import dedup_lines, line_dedup
from millrace.llm.mixing import mix_sources, mixed_documents
from tests.llm.test_free import WIDE, clashing
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "a b  c", "en", "s1", 6), (2, "a\tb c", "en", "s1", 5), (3, None, None, None, None), (4, "", "en", "s2", 0), (5, " \n ", "en", None, 3), (1, "a b  c", "en", "s1", 6),
    (None, "x y z", "en", "s3", 5), (None, "x y z", "en", "s3", 5), (6, "w " * 5000, "en", "s1", 10000), (7, "é ü\u00a0ß", "de", "s2", 5),
]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck(SF, registry.ORACLE_SQL[name]))


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def test_mix_meets_targets_and_limits(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), "en", f"s{i % 7}" if i % 3 else "hot", i) for i in range(3000)], SCHEMA)
    m = mix_sources(docs).toPandas()
    per = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all() and (per.target <= 2 * per["size"] + 1e-6).all()
    assert (m.taken <= 2 * m["size"]).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-3
    assert rows(m) == rows(mix_sources(docs.repartition(7)).toPandas())


def test_mix_edges(spark):
    m = mix_sources(edge(spark).withColumnsRenamed({"lang": "size", "n_chars": "target"})).toPandas()
    assert len(m) == len(EDGE) and (m.taken <= 2 * m["size"]).all()
    assert mix_sources(edge(spark).limit(0)).count() == 0
    out = mixed_documents(edge(spark).withColumn("taken", F.lit("clash")))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "taken"]
    assert out.where("doc_id = 3").count() == 0


def test_mixed_documents_near_target(spark):
    docs = spark.createDataFrame([(i, "w " * 20, "en", f"s{i % 5}", i) for i in range(2000)], SCHEMA)
    target = {r.source: r.target for r in mix_sources(docs).select("source", "target").distinct().collect()}
    got = {r.source: r.n * 20 for r in mixed_documents(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(got[s] - t) <= 20 for s, t in target.items())


def test_exact_dedup_edges(spark):
    d = exact_dedup(edge(spark).withColumn("keep_id", F.lit("clash"))).toPandas()
    assert len(d) == len(EDGE)
    assert d.groupby("text_sha256").kept.sum().eq(1).all()
    same = d[d.doc_id.isin([1, 2])]
    assert set(same.group_size) == {3} and set(same.keep_id) == {1}
    empty = d[d.doc_id.isin([3, 4, 5])]
    assert set(empty.keep_id) == {5} and set(empty.group_size) == {3}
    assert exact_dedup(edge(spark).limit(0)).count() == 0


def test_exact_dedup_tells_clashing_chunks_apart(spark):
    docs = spark.createDataFrame([(i, t * 9, "en", "s", 0) for i, t in enumerate(["Abc. Def. ", "Abc. Xyz. ", "Abc. Def. ", "Qrs. Def. ", "Abc. Def. Abc. "])], SCHEMA)
    real = exact_dedup(docs, pattern=r"(?s).{1,5}").toPandas()
    weak = exact_dedup(docs, pattern=r"(?s).{1,5}", hashed=lambda c: F.length(c).cast("long")).toPandas()
    assert rows(real) == rows(weak) and set(real[real.doc_id.isin([0, 2])].group_size) == {2}


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    data = [(1, f"head one\n{long}\ntail", "en", "s", 1), (2, f"other\nstart\n{long}", "en", "s", 1), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, long, "en", "s", 1), (5, long, "en", "s", 1), (None, long, "en", "s", 1)]
    docs = spark.createDataFrame(data, SCHEMA).withColumn("lines", F.lit("clash"))
    out = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert out[1].text == data[0][1] and long not in out[2].text and out[5].text == "" and out[None].text == ""
    assert out[3].text is None and out[3]["__lines"] == 0 and out[4].text == ""
    kept = dedup_lines(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4}
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_compares_bytes(spark):
    a, b = " ".join(["alpha"] * 60), " ".join(["bravo"] * 60)
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, a, "en", "s", 1)], SCHEMA)
    out = {r.doc_id: r.text for r in line_dedup(docs, hashed=lambda c: F.lit(1).cast("long")).collect()}
    assert out == {1: a, 2: b, 3: ""}


def test_line_dedup_takes_whole_passages(spark):
    """Passages of 2 to 20 short lines, each in two texts with other surroundings, go whole from the second."""
    data, planted = [], {}
    for n in range(2, 21):
        words = 49 if n < 4 else 17
        planted[n] = [" ".join(f"p{n}.{i}.{k}" for k in range(words)) for i in range(n)]
        for copy in range(2):
            around = [[f"before {n} {copy} {i}" for i in range(3)], [f"after {n} {copy} {i}" for i in range(3)]]
            data.append((100 * copy + n, "\n".join([*around[0], *planted[n], *around[1]]), "en", "s", 1))
    again = "\n".join(["ten words that are said over and over again here"] * 20)
    data += [(300, again, "en", "s", 1), (301, "x\n\ny", "en", "s", 1), (302, "x\n\ny", "en", "s", 1)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, text, *_ in data[:-3]:
        n, lines = i % 100, text.split("\n")
        assert out[i].text == (text if i < 100 else "\n".join(lines[:3] + lines[-3:])), i
        assert out[i]["__removed_lines"] == (0 if i < 100 else n)
    assert out[300]["__removed_lines"] == 15  # the first five lines are the first place
    assert out[301].text == "x\n\ny"


def test_wide_ids_and_clashing_columns(spark):
    d = clashing(spark.createDataFrame(WIDE, SCHEMA).coalesce(1))
    d = d.withColumns({c: F.lit("x") for c in ("__mix_size", "__mix_row", "gone", "left", "lines", "removed", "own_th", "__lines", "start", "back`tick", "a.b")})
    want = {r.doc_id for r in d.collect()}
    for out in (mix_sources(d), exact_dedup(d), line_dedup(d), dedup_lines(d)):
        assert {r.doc_id for r in out.collect()} == want
    assert dedup_lines(d).columns == mixed_documents(d).columns == d.columns
    assert sorted(map(repr, dedup_lines(d).collect())) == sorted(map(repr, d.collect()))
    assert {r.doc_id for r in mixed_documents(d).collect()} <= want


def test_line_dedup_of_long_repetitive_texts_is_linear(spark):
    def seconds(n: int) -> float:
        d = spark.createDataFrame([(k, "\n".join(["one and the same line"] * n), "en", "s", 1) for k in range(2)], SCHEMA)
        began = time.time()
        out = {r.doc_id: r["__removed_lines"] for r in line_dedup(d).collect()}
        assert out[1] == n and out[0] > n * 0.9
        return time.time() - began

    seconds(5_000)
    small, large = seconds(40_000), seconds(160_000)
    assert large < 8 * small + 5
