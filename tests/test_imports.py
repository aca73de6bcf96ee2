"""Rows of imports: defaults, specification maps, packaging from the row or its specification."""

from pyspark.sql import functions as F

from millrace.operators import imports as I


def test_spec_map(spark):
    texts = ["Motor: 500W; Range:80 km ;plain; a:b: c;Motor : last", "", None, "x", ":empty key", "k:"]
    got = [r.m for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", I.spec_map(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [{"Motor": "last", "Range": "80 km", "a:b": "c"}, {}, {}, {}, {"": "empty key"}, {"k": ""}]


def test_import_defaults_and_missing_columns(spark):
    rows = spark.createDataFrame([(1, "u", " EV1 ", "a: b"), (2, "u", "EV1", None), (3, "u", " ", "x"), (4, "u", None, "x"), (5, "v", "红色", "锂电池")], "n long, user_id string, model string, spec_zh string")
    library = spark.createDataFrame([("u", "EV1-A")], "user_id string, sku string")
    got = {r.n: r for r in I.imported_products(rows, library, "n", "cat").collect()}
    assert {n: r.sku for n, r in got.items()} == {1: "EV1", 2: "EV1-B", 5: "红色"}
    assert (got[1].name_zh, got[2].name_zh, got[5].name_en) == ("a: b", "EV1-B", "Lithium Battery")
    r = got[1]
    assert (r.price_rmb, r.moq, r.specs, r.image_path, r.source_file, r.category, r.carton_size, r.cbm, r.units_per_carton) == (0.0, 1, {"a": "b"}, "", "", "cat", "", 0.0, 0)


def test_import_takes_what_is_readable(spark):
    rows = spark.createDataFrame([(1, "u", "m", "n", "en", "", "12.5", "7", "a.jpg", "0"), (2, "u", "k", None, None, None, "cheap", "-", None, "big")], "n long, user_id string, model string, name_zh string, name_en string, spec_zh string, price_rmb string, moq string, image_path string, cbm string")
    got = [tuple(r) for r in I.imported_products(rows, rows.limit(0).select("user_id", F.col("model").alias("sku")), "n").select("sku", "name_zh", "name_en", "price_rmb", "moq", "image_path", "cbm").orderBy("sku").collect()]
    assert got == [("k", "k", "k", 0.0, 1, "", 0.0), ("m", "n", "en", 12.5, 7, "a.jpg", 0.0)]


def test_packaging_from_the_row_or_the_specification(spark):
    spec = "GW: 12kg; NW: 10; Carton size: 1x2x3; Pcs/ctn: 4 pcs; CBM: 0.5; Packing type: box"
    items = spark.createDataFrame([(1, "u", "m", "n", spec, 5.0, "", 0.0, None), (2, "u", "", "", spec, None, "own", 9.5, 7), (3, "u", None, None, None, None, None, None, 0)], "id long, user_id string, model string, name_zh string, spec_zh string, price_rmb double, carton_size string, gross_weight double, units_per_carton int")
    got = {r.id: r for r in I.web_products(items, "id").collect()}
    pick = lambda r: (r.model, r.carton_size, r.gross_weight, r.net_weight, r.cbm, r.units_per_carton, r.packing_type, r.currency, r.price_cny)
    assert pick(got[1]) == ("m", "1x2x3", 12.0, 10.0, 0.5, 4, "box", "RMB", 0.0)
    assert pick(got[2]) == ("GW: 12kg; NW: 10; Ca", "own", 9.5, 10.0, 0.5, 7, "box", "RMB", 0.0)
    assert pick(got[3]) == ("Item_3", "", 0.0, 0.0, 0.0, 0, "", "RMB", 0.0)


def test_images_by_folder(spark):
    from millrace.operators import images as J

    pictures = spark.createDataFrame([("x/ev1-front.jpg", "e-motor cycles"), ("x/k.jpg", "e-motor cycles"), ("x/a/ev1.jpg", "other"), ("x/b/zz9.png", "price_list"), ("x/c/zz9.png", "old Price list 2")], "path string, folder string")
    rows = [(1, "EV1", "E_motor-cycles.v2.xlsx"), (2, "AK7", "emotorcycles.pdf"), (3, "EV1", "nowhere.xlsx"), (4, "zz9", "price list.xlsx"), (5, "zz9", "2024 price-list new.xlsx"), (6, "", "price list.xlsx"), (7, None, "other.csv"), (8, "q", "other.csv"), (9, "EV1", None)]
    got = sorted(tuple(r) for r in J.match_in_folder(spark.createDataFrame(rows, "id int, model string, source_file string"), pictures).collect())
    assert got == [(1, "x/ev1-front.jpg"), (2, "x/k.jpg"), (3, "x/a/ev1.jpg"), (4, "x/b/zz9.png"), (5, "x/b/zz9.png"), (9, "x/a/ev1.jpg")]


def test_scored_images_by_names_of_any_length(spark):
    from millrace.operators import images as J

    models = ["AB-7", "zz", "x", "", "a-b", None, "ab--9", "12-zz", "P-Q-77", "-", "lamp-k9", "UV", "no", "日", "SKU-1001"]
    stems = ["ab7", "z", "q1", "photo-12-front", "zz", "k", "lamp", "uvw", "77", "日本", "sku-100", "b", ""]
    paths = [f"images/{s}.jpg" for s in stems]
    want = {}
    for n, m in enumerate(models):
        m = (m or "").lower()
        scores = [3 if s == m else 2 if (m and m in s) or (s and s in m) else int(any(x and x in s for x in m.split("-"))) for s in stems]
        if max(scores) and models[n] is not None:
            want[n] = (paths[scores.index(max(scores))], max(scores))
    got = J.match_scored(spark.createDataFrame(list(enumerate(models)), "id long, model string"), spark.createDataFrame(list(enumerate(paths)), "idx long, path string"))
    assert {r.id: (r.path, r.score) for r in got.collect()} == want
    assert len(want) >= 10
