"""Files that other programs read: bytes on disk, read back by Python's own csv and json."""

import csv
import glob
import io
import json
import random

import pytest

from millrace.sources import catalog, files


def texts(folder):
    return {f.removeprefix(f"{folder}/"): open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/**/part-*", recursive=True))}


ODD = [("a", 1, 'say "hi", x'), ("a", 2, "two\nlines"), ("b/c", 3, None), ("b/c", 4, ""), ("ü", 5, " keep "), ("a", 6, "型号")]


def test_grouped_files_have_mark_header_and_order(spark, tmp_path):
    df = spark.createDataFrame([(g, i, t) for g, i, t in ODD] + [("hot", i, f"t{i}") for i in range(100, 1100)], "g string, id int, t string").repartition(7)
    files.write_csv_files(df, f"{tmp_path}/out", ["id", "t"], ["id"], "g", rows=300)
    found = texts(f"{tmp_path}/out")
    assert all(b.startswith(b"\xef\xbb\xbfid,t\n") and b.count(b"\xef\xbb\xbf") == 1 for b in found.values())
    rows = {name.rsplit("/", 1)[0]: list(csv.reader(io.StringIO(b.decode("utf-8-sig"), newline="")))[1:] for name, b in found.items()}
    assert len(rows) == len(found) == 7
    assert [sum(len(r) for n, r in rows.items() if n.startswith("g=hot")), *(len(rows[f"g=hot/file_no={k}"]) for k in range(4))] == [1000, 300, 300, 300, 100]
    assert [int(x[0]) for k in range(4) for x in rows[f"g=hot/file_no={k}"]] == list(range(100, 1100))
    assert rows["g=a/file_no=0"] == [["1", 'say "hi", x'], ["2", "two\nlines"], ["6", "型号"]]
    assert [r for n, r in rows.items() if n.startswith("g=b")] == [[["3", ""], ["4", ""]]] and rows["g=ü/file_no=0"] == [["5", " keep "]]


def test_export_is_one_file_of_ten_columns(spark, tmp_path):
    make = lambda n: spark.createDataFrame([(i, f"s{i}", "名", "n", "c" if i % 2 else "d", 1.5, None, i, "img", "f.xlsx", "u" if i % 3 else "v") for i in range(n)], "id long, sku string, name_zh string, name_en string, category string, price_rmb double, price_usd double, moq int, image_path string, source_file string, user_id string")
    files.export_csv(make(50).repartition(5), f"{tmp_path}/a", "u", limit=20)
    (data,) = texts(f"{tmp_path}/a").values()
    lines = data.decode("utf-8-sig").splitlines()
    assert lines[0] == "id,sku,name_zh,name_en,category,price_rmb,price_usd,moq,image_path,source_file" and len(lines) == 21
    assert lines[1] == "1,s1,名,n,c,1.5,,1,img,f.xlsx" and [int(x.split(",")[0]) for x in lines[1:]] == [i for i in range(50) if i % 3][:20]
    files.export_csv(make(50), f"{tmp_path}/b", "u", category="d")
    assert all(x.split(",")[4] == "d" for x in list(texts(f"{tmp_path}/b").values())[0].decode().splitlines()[1:])
    files.export_csv(make(50), f"{tmp_path}/c", "nobody")
    assert list(texts(f"{tmp_path}/c").values()) == [("﻿" + lines[0] + "\n").encode()]


def library(n, seed=0):
    r = random.Random(seed)
    text = lambda: "".join(r.choice('ab"\\{}[],: 型\n\t') for _ in range(r.randint(0, 12)))
    return {f"k{i}{text()}": {"model": text(), "price": i / 4 if i % 3 else None, "last_updated": None if i % 5 == 0 else "2024", "more": {"deep": [1, {"x": text()}]}} for i in range(n)}


@pytest.mark.parametrize("indent", [2, None, 0])
@pytest.mark.parametrize("part", ["600", "128m"])
def test_json_objects_are_read_in_parts(spark, tmp_path, indent, part):
    lib, other = library(60), library(7, 1)
    (tmp_path / "lib").mkdir()
    for name, x in (("a", lib), ("b", other), ("c", {})):
        (tmp_path / "lib" / f"{name}.json").write_text(json.dumps(x, ensure_ascii=False, indent=indent), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if part == "600" and indent is not None:
            assert spark.read.text(f"{tmp_path}/lib/a.json").rdd.getNumPartitions() > 5
        got = {(x.product_key, x.model, x.price, x.last_updated) for x in catalog.read_library_json(spark, f"{tmp_path}/lib").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(k, v["model"], v["price"], v["last_updated"]) for k, v in [*lib.items(), *other.items()]}


def test_json_objects_are_written_for_any_reader(spark, tmp_path):
    lib = library(25)
    df = spark.createDataFrame([(k, v["model"], v["price"], v["last_updated"]) for k, v in lib.items()], "product_key string, model string, price double, last_updated string").repartition(4)
    files.write_json_objects(df, f"{tmp_path}/out", "product_key", rows=10)
    found = [json.loads(b) for b in texts(f"{tmp_path}/out").values()]
    assert [len(x) for x in found] == [10, 10, 5]
    every = {k: v for x in found for k, v in x.items()}
    assert every.keys() == lib.keys() and all(v.get("price") == lib[k]["price"] and v.get("model") == lib[k]["model"] for k, v in every.items())
    assert {x.product_key for x in catalog.read_library_json(spark, f"{tmp_path}/out").collect()} == set(lib)


def test_places_over_ranges_of_any_size(spark):
    """Numbers in an order, over many ranges, over one, and within groups of which one has most rows."""
    from millrace.plans.ordering import numbered, numbered_within

    r = random.Random(3)
    data = [(i, r.choice(["hot"] * 8 + ["a", None]), r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, g string, k int").repartition(5)
    want = {row[0]: n for n, row in enumerate(sorted(data, key=lambda x: (x[2], x[0])), 1)}
    for rows in (7, 10_000):
        assert {x.id: x.place for x in numbered(df, "k", "id", rows=rows).collect()} == want
        got = {(x.g, x.place): x.id for x in numbered_within(df, "g", "k", "id", rows=rows).collect()}
        for g in ("hot", "a", None):
            own = sorted((x for x in data if x[1] == g), key=lambda x: (x[2], x[0]))
            assert [got[g, n] for n in range(1, len(own) + 1)] == [x[0] for x in own]
    assert numbered(df.limit(0), "k", "id").count() == 0


def test_staged_tables_are_cleared_by_name_and_age(spark, tmp_path, monkeypatch):
    from millrace.sources import staging

    monkeypatch.setattr(staging, "shared_base", lambda _: f"file://{tmp_path}/shared")
    assert staging.clear(spark) == 0
    a, b = staging.staged(spark.range(3), "some"), staging.staged(spark.range(4), "some-other")
    (tmp_path / "shared" / "own").mkdir()
    assert staging.clear(spark, older_than=3600) == 0 and a.count() == 3
    assert staging.clear(spark, "some") == 1 and b.count() == 4
    assert staging.clear(spark) == 1 and [f.name for f in (tmp_path / "shared").iterdir()] == ["own"]


def test_shared_folder_without_a_setting():
    """Tests have a folder of their own; on a cluster it is an error."""
    from types import SimpleNamespace

    from millrace.sources.staging import shared_base

    def session(master, conf=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(_conf=SimpleNamespace(get=lambda *_: conf), master=master, applicationId=f"app-{master}"))

    assert shared_base(session("local[4]")) == shared_base(session("local[4]")) != shared_base(session("local"))
    assert shared_base(session("yarn", "hdfs:///x")) == "hdfs:///x"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,900]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_base(session(master))
