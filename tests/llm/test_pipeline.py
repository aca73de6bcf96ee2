"""Each stage of the pipeline against what its input calls for, and that all rows of the last stage can be traced."""

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import registry
from tests.llm.test_free import EDGE, SCHEMA, WIDE, brute_join, brute_quality, check_packing, clashing

SF = "/root/testdata/sf0.001"


def by_sql(folder, sql):
    """What SQL says of the documents that a stage wrote."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    return con.execute(sql).df()


def test_stages(spark, tmp_path):
    """Every stage against a version of its own: loops for the rules and the join, SQL for lines and mix, the tokenizer for pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    start, judged, lines, near, mixed, packed = seen
    assert all(d.columns == docs.columns for d in seen[:-1])
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    rows = start.select("doc_id", "lang", "text").collect()
    assert ids(judged) == sorted(r.doc_id for r, (_, kept, _, _) in zip(rows, brute_quality(rows), strict=True) if kept)
    stays = by_sql(f"{tmp_path}/0", registry.SQL_OP10)
    texts = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(texts) == sorted((i, t) for i, t, gone in zip(stays.doc_id, stays.text, stays.removed_lines) if not gone or t.encode().split())
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.doc_id in set(stays[stays.removed_lines > 0].doc_id))
    assert ids(near) == sorted({c for _, c, _, _ in brute_join(texts)})
    mix = by_sql(f"{tmp_path}/2", registry.SQL_OP1)  # whole documents: at a budget's end one is in if half of it is
    want = sorted(int(i) for i, size, taken in zip(mix.doc_id, mix["size"], mix.taken, strict=True) if size for _ in range((2 * taken + size) // (2 * size)))
    assert ids(mixed) == want
    p = packed.toPandas()
    check_packing(p, 2048)
    tokenizer = Tokenizer.from_file(registry.vocabulary("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert sorted(zip(p[p.start == 0].doc_id, p[p.start == 0].doc_tokens)) == want
    assert p.length.sum() == sum(n for _, n in want)


def test_run_is_the_same_again(spark):
    a, b = (corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").toPandas() for _ in range(2))
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls, repeats, wide ids and clashing columns beside good documents; and an empty table."""
    good = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("length(text) between 800 and 4000").limit(60).collect()
    rows = [(2**60 + 2 * i + 1, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(good)]
    odd = [*rows, *rows[:3], *EDGE[:-1], *WIDE, (None, good[5].text, None, None, None)]
    docs = clashing(spark.createDataFrame(odd, SCHEMA).coalesce(1))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").toPandas()
    check_packing(out, 2048)
    ids = set(out.doc_id.dropna().astype("int64"))
    assert len(ids) > 20 and ids <= {r[0] for r in rows}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert all(f(spark, docs, SF).columns == docs.columns for _, f in corpus_pipeline.STAGES[:-1])
