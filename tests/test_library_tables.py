"""The stored search index and the library table that upserts change in place."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import library as L
from millrace.operators import library_table as T
from millrace.operators import search_index as X

SCHEMA = "id long, user_id string, sku string, name_zh string, name_en string"


def products(n=400, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcÄ型%_ -") for _ in range(r.randint(0, 9)))
    return [(i, r.choice("uuv"), word(), r.choice([None, word()]), word() + " Lamp") for i in range(n)]


@pytest.mark.parametrize("keyword", ["aba", "LAMP", "lam_", "a%lamp", "b_c", "ab", "%", "", "型ab", "Äb", r"a\%b", r"c\_a", "nowhere", "aaaa", "-a-"])
def test_index_equals_scan(spark, tmp_path_factory, keyword):
    folder = f"file://{tmp_path_factory.getbasetemp()}/postings"
    df = spark.createDataFrame(products(), SCHEMA)
    if not glob.glob(folder.removeprefix("file://")):
        X.add_postings(df, folder)
    got = X.indexed_search(df, folder, "u", keyword).select("id", "rank").collect()
    assert got == L.search_products(df, "u", keyword).select("id", "rank").collect()


def test_index_follows_upserts_and_reads_its_grams_alone(spark, tmp_path):
    folder, df = f"file://{tmp_path}/p", spark.createDataFrame(products(), SCHEMA)
    X.add_postings(df, folder)
    changed = df.where("id % 3 = 0").withColumn("name_en", F.lit("Golden fan"))
    new = df.where("id % 3 != 0 and id % 7 != 0").unionByName(changed)
    X.add_postings(changed, folder)
    for keyword in ("golden", "lamp", "den_f"):
        assert X.indexed_search(new, folder, "u", keyword, 1000).collect() == L.search_products(new, "u", keyword, 1000).collect()
    found = X.postings(spark, folder, "u", X.needed_grams("golden"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(gram" in plan
    assert found.count() < spark.read.parquet(folder).count() / 5
    assert len({f.split("folder=")[1].split("/")[0] for f in glob.glob(f"{tmp_path}/p/folder=*")}) > 20


def files(path):
    return {f.split("folder=")[1] for f in glob.glob(f"{path}/folder=*/*.parquet")}


def test_upserts_rewrite_the_touched_folders_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i % 5}", f"s{i}", f"n{i}", None) for i in range(1000)], SCHEMA)
    T.create_library(df, "lib_in_place", f"file://{tmp_path}/lib", folders=16, buckets=8)
    try:
        before = files(f"{tmp_path}/lib")
        new = spark.createDataFrame([(5, "u0", "s5", "changed", "E"), (2000, "u9", "new", "added", "E"), (6, "u0", "s5", "later", "E")], SCHEMA)
        touched = {r[0] for r in new.select(T.folder_of(16)).distinct().collect()}
        own = spark.table("lib_in_place").where(F.col("folder").isin(list(touched)))
        latest = new.groupBy(*T.KEY).agg(F.max("id").alias("new"))
        plan = own.join(latest.hint("merge"), T.KEY, "left")._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan")].split("\n")
        assert "Exchange" not in "\n".join(scan[-4:]) and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1
        T.upsert_library(spark, "lib_in_place", new, ["name_zh"], folders=16)
        after = files(f"{tmp_path}/lib")
        assert {f for f in before if int(f.split("/")[0]) not in touched} == {f for f in after if int(f.split("/")[0]) not in touched}
        assert not {f for f in before & after if int(f.split("/")[0]) in touched}
        got = {(r.user_id, r.sku): r.name_zh for r in spark.table("lib_in_place").collect()}
        assert len(got) == 1001 and got["u0", "s5"] == "later" and got["u9", "new"] == "added" and got["u1", "s1"] == "n1"
        assert sorted(spark.table("lib_in_place").columns) == sorted([*df.columns, "folder"])
        T.upsert_library(spark, "lib_in_place", new.limit(0), ["name_zh"], folders=16)
        assert files(f"{tmp_path}/lib") == after
    finally:
        spark.sql("DROP TABLE lib_in_place")
