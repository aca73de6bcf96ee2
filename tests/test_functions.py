"""Hand cases of single functions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import language as G
from millrace.functions import models as M
from millrace.functions import prices as P
from millrace.functions import specs as S
from millrace.operators import library as L
from millrace.operators import quotes as Q


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_clean_price(spark):
    got = values(spark, P.clean_price, ["1000", "1,000", "¥1000", "$100", "1000 USD", "1000-1500", "1000~1500", "1000 or 1500", "5K", "10W", "10% off", "8折", "", None, "abc", "5KG"])
    assert got == pytest.approx([1000, 1000, 1000, 720, 7200, 1250, 1250, 1250, 5000, 100000, 0.1, 0.8, None, None, None, 5])


def test_price_from_value(spark):
    got = values(spark, P.price_from_value, ["USD 10", "10 US Dollar", "¥1,200", "35元", "88", "500W", "none", None])
    assert [tuple(g) if g else None for g in got] == [(10.0, 72.0, "USD"), (10.0, 72.0, "USD"), (1200.0, 1200.0, "CNY"), (35.0, 35.0, "CNY"), (88.0, 88.0, "CNY"), None, None, None]


def test_clean_spec(spark):
    got = values(spark, S.clean_spec, ["Motor: 4000W Battery: 72V", "Motor：1；Range：2", "a: 1; B: 2;", None, " nan ", "Size: 1360*", "2.50-17;2.75-17"])
    assert got == ["Motor: 4000W\nBattery: 72V", "Motor:1\nRange:2", "a: 1\nB: 2", S.DEFAULT_SPEC, S.DEFAULT_SPEC, "Size: 1360* (尺寸单位缺失)", "2.50-17;2.75-17"]


def test_format_spec(spark):
    got = values(spark, S.format_spec, ["Motor 4000W", "Motor: 1 Battery: 2", "free text", "", None])
    assert got == ["Motor: 4000W", "Motor: 1\nBattery: 2", "free text", "", ""]


def test_dimensions(spark):
    got = values(spark, S.extract_dimensions, ["10×5×3cm", "Dia:10cm H:20cm", "L:10 W:5 H:3", "10*10cm", "1 x 2 x 3 m", "none"])
    assert [(g.length, g.width, g.height, g.diameter, g.unit) if g else None for g in got] == [(100, 50, 30, None, "cm"), (None, None, 200, 100, "cm"), (10, 5, 3, None, "mm"), (100, 100, None, None, "cm"), (1, 2, 3, None, "mm"), None]


def test_amount_in_words(spark):
    got = values(spark, G.amount_in_words, [0.0, 7.0, 115.5, 20000.0, 1234567.89, None], "double")
    assert got == ["ZERO USD", "SEVEN USD ONLY.", "ONE HUNDRED FIFTEEN AND CENTS 50/100 USD ONLY.", "TWENTY THOUSAND USD ONLY.", "ONE MILLION TWO HUNDRED THIRTY FOUR THOUSAND FIVE HUNDRED SIXTY SEVEN AND CENTS 89/100 USD ONLY.", "ZERO USD"]


def test_models(spark):
    assert values(spark, M.is_valid_model, ["EV100", "payment 3", "a:1", "12mm", "X", "Item_3", None]) == [True, False, False, False, False, False, False]
    assert values(spark, M.normalize_model, ["Model ABC-1", "型号 X1", None]) == ["abc1", "x1", ""]
    assert sorted(values(spark, M.model_keywords, ["ABC-1234"])[0]) == ["1234", "abc", "abc-1234", "abc1234"]
    assert values(spark, lambda c: M.score_row(c, F.lit(100.0), F.lit("Motor 500W and more words"), 2024), ["EV100", "payment", "", "产品_R3"]) == [7.0, -1.0, 0.0, 7.0]


def test_suffixes(spark):
    got = [r[0] for r in spark.range(0, 703).select(L.suffix(F.col("id")).alias("s")).orderBy("id").collect()]
    assert got[:3] == ["-A", "-B", "-C"] and got[25:28] == ["-Z", "-AA", "-AB"] and got[701] == "-ZZ"


def test_discount_ties_and_gates(spark):
    got = values(spark, Q.best_discount, [0.0, 999.0, 1000.0, 5000.0, 20000.0], "double")
    assert [tuple(g) for g in got] == [(0.0, None), (0.0, None), (100.0, "FIXED100"), (500.0, "BULK10"), (4000.0, "VIP20")]


def test_translation_keeps_codes(spark):
    df = spark.createDataFrame([("锂电池ABC12红色",), (None,), ("",)], "t string")
    got = [r.en for r in G.translate_column(df, "t", "en", protect=True).collect()]
    assert got == ["Lithium BatteryABC12Red", None, ""]
    assert [r.en for r in G.translate_column(df, "t", "en").collect()] == got


def test_json_and_csv_round_trip(spark, tmp_path):
    from millrace.sources import catalog

    df = spark.createDataFrame([("k1", "EV1", 1.5, "2024-01-01"), ("k2", None, None, None)], "product_key string, model string, price double, last_updated string")
    catalog.write_library_json(df, f"{tmp_path}/lib")
    assert sorted(map(tuple, catalog.read_library_json(spark, f"{tmp_path}/lib").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_queries_need_no_session():
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert run.returncode == 0, run.stderr


def test_write_groups_and_csv(spark, tmp_path):
    from millrace.operators.grouping import write_groups
    from millrace.sources import catalog

    df = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("c", "", 3), ("d", None, 4)], "model string, category string, n int")
    write_groups(df, f"{tmp_path}/groups", "category")
    back = spark.read.parquet(f"{tmp_path}/groups")
    assert sorted((r.group, r.n) for r in back.collect()) == [("Uncategorized", 3), ("Uncategorized", 4), ("x", 1), ("x", 2)]
    catalog.write_csv(df.withColumn("specs", F.create_map(F.lit("k"), F.col("model"))), f"{tmp_path}/csv")
    assert sorted(r.specs for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect())[0].startswith("{")


def test_header_rules(spark):
    from millrace.operators import grid

    cells = [("f", "s", 1, 1, "Price list of a company with a long name and address"), ("f", "s", 2, 1, "No. photo"), ("f", "s", 2, 2, "Item No."), ("f", "s", 2, 3, "Price"), ("f", "s", 2, 4, "Qty"), ("f", "s", 3, 2, "EV1"), ("f", "s", 3, 3, "$5")]
    df = spark.createDataFrame(cells, "file string, sheet string, row_no int, col_no int, value string")
    heads = grid.header_row(df)
    assert heads.first().header == 2
    m = grid.header_mapping(df, heads).first()
    assert (m.model, m.price, m.qty, m.name) == (2, 3, 4, 2)
    assert grid.sheet_currency(df, heads, grid.header_mapping(df, heads)).first().currency == "USD"


def test_suffixes_go_on(spark):
    """Every row gets a name of its own beyond -ZZ, in the reference's order, and names in use are passed over."""
    rows = [("u", "m", i) for i in range(6000)] + [("u", "m-B", 6000), ("v", "", 6001), ("v", "q", 6002)]
    library = spark.createDataFrame([("u", "m-AA"), ("u", "m-[A")], "user_id string, sku string")
    got = {r.idx: r.new_sku for r in L.unique_skus(spark.createDataFrame(rows, "user_id string, model string, idx long"), library, "idx").collect()}
    every = (f"m-{chr(64 + s)}" if s <= 26 else f"m-{chr(64 + (s - 1) // 26)}{chr(65 + (s - 1) % 26)}" for s in range(1, 7000))
    free = [x for x in every if x not in {"m-B", "m-AA", "m-[A"}]
    assert [got[i] for i in range(6000)] == ["m", *free[:5999]]
    assert got[6000] == "m-B" and 6001 not in got and got[6002] == "q"


def test_spec_rules(spark):
    texts = ["Package: 1360*", "Motor Power:", "Motor: 4000W\nBattery: 72V", "Package: 1360* (may be incomplete)", "", "Motor: 4000W Battery: 72V 20AH Controller: 150A Front Brake: Front di ", "box of 10 pcs per set"]
    assert values(spark, S.fix_truncated_spec, texts) == [texts[0] + " (尺寸单位缺失)", texts[1] + " (may be incomplete)", *texts[2:5], texts[5] + " (may be incomplete)", texts[6]]
    breaks = ["Motor: 4000W Battery: 72V 20AH", "Motor: 4000W", "", "This is a simple description without params", "Package size: 1 USB Port: 2"]
    assert values(spark, S.break_before_names, breaks) == ["Motor: 4000W\nBattery: 72V 20AH", *breaks[1:4], "Package size: 1 USB\nPort: 2"]
    assert values(spark, S.clean_spec, ["Motor：4000W Battery：72V 20AH Package size：1360*", "长度：1720mm；宽度：650mm"]) == ["Motor:4000W\nBattery:72V 20AH Package\nsize:1360* (尺寸单位缺失)", "长度:1720mm\n宽度:650mm"]


def test_format_spec_lines(spark):
    got = values(spark, S.format_spec, ["Motor power: 5", "Motor power: 5 Speed: 3", "Motor Speed:", "3 pcs of it", "colour red", "Top speed 45 km/h\n\n  Net 3kg", "a: b,c:d", "重量：5kg 尺寸：1m"])
    assert got == ["Motor power: 5", "power: 5\nSpeed: 3", S.DEFAULT_SPEC, "3 pcs of it", "colour red", "Top: speed 45 km/h\nNet: 3kg", "a:\nb,c:d", "重量: 5kg\n尺寸:1m"]


def test_price_from_value_against_python(spark):
    import random
    import re

    def want(t):
        t = (t or "").strip()
        for currency, rate, patterns in (("USD", 7.2, P._USD), ("CNY", 1.0, P._CNY)):
            m = next((m for p in patterns if (m := re.search(p, t))), None)
            if m and (v := number(m[1])) is not None and v > 0:
                return v, v * rate, currency
        m = re.search(P._PLAIN, t)
        v = number(m[1]) if m else None
        return (v, v, "CNY") if v is not None and 0.01 < v < 1_000_000 else None

    def number(x):
        try:
            return float(x.replace(",", ""))
        except ValueError:
            return None

    rng = random.Random(1)
    words = ["12", "1,250.5", "USD", "$", "¥", "元", "RMB", "W", "kg", " ", " ", "a", "0", "us dollar", "7K", "%", "3.5"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(600)]
    got = values(spark, P.price_from_value, texts)
    for t, g in zip(texts, got):
        w = want(t)
        assert (None if g is None or g[0] is None else (g[0], g[2])) == (w and (w[0], w[2])), t
        assert w is None or g[1] == pytest.approx(w[1], abs=0.0051), t  # to the cent


def sheet(spark, rows):
    """Cells of one sheet from rows of values."""
    cells = [("f", "s", r, c, v) for r, values in enumerate(rows, 1) for c, v in enumerate(values, 1)]
    return spark.createDataFrame(cells, "file string, sheet string, row_no int, col_no int, value string")


def test_every_role_has_its_words_and_no_others(spark):
    from millrace.operators import grid
    from millrace.operators.header_words import ROLES

    heads = {"model": "货号", "spec": "Frequency", "name": "Designation", "price": "DDP", "qty": "MOQ", "packing": "CBM", "category": "Grade", "remark": "附注", "brand": "商标", "cert": "RoHS", "hscode": "Customs code", "lead_time": "交货期", "warranty": "质保", "barcode": "GTIN", "origin": "原产地"}
    assert list(heads) == list(ROLES)
    df = sheet(spark, [["", *heads.values(), "zzz"], ["x"] * 17])
    m = grid.header_mapping(df, spark.createDataFrame([("f", "s", 1)], "file string, sheet string, header int")).first()
    assert {r: m[r] for r in ROLES} == {r: i for i, r in enumerate(ROLES, 2)}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([["No.", "Item description", "Cost"], ["1", "a", "5"], ["2", "b", "6"], ["3", "c", "7"]], {"model": None, "spec": 2, "price": 3}),  # serial numbers; description is specifications
        ([["Model specification", "Model", "Price"], ["a", "X1", "5"]], {"model": 2, "spec": 1, "price": 3}),  # a strong word for specifications
        ([["Picture", "Item No.", "Name"], ["x", "A1", "b"]], {"model": 2, "name": 3, "price": None}),
        ([["Model", "Size"], ["A1", "5"], ["A2", "6"]], {"model": 1, "name": 1, "spec": 2, "price": None}),  # no name: the model; the number is taken
        ([["Thing", "Stuff", "More"], ["ab", "X1", "12.5"], ["cd e", "X2", "13"], ["f g", "X3", "14"]], {"model": 2, "name": None, "price": 3}),  # by contents
        ([["Model", "Price"], ["=DISPIMG(1)", "5"], ["=DISPIMG(2)", "6"], ["=DISPIMG(3)", "7"]], {"model": None, "price": 2}),  # formulas
        ([["Model", "Model"], ["A1", "B2"]], {"model": 1}),
    ],
)
def test_header_mapping_cases(spark, rows, want):
    from millrace.operators import grid

    m = grid.header_mapping(sheet(spark, rows), spark.createDataFrame([("f", "s", 1)], "file string, sheet string, header int")).first()
    assert {k: m[k] for k in want} == want


def test_no_products(spark):
    from millrace.operators import grid

    bad = ["Contract 12", "grand total", "3. warranty one year", "合计", "USD 1,200", "buyer", "2、（ 交货", "Sales contract", "total payment", "4. brand name", "(stamp here)", "Approved", "ref no: A-1", "PO20240101", "装箱单", "Consignee", "test report", "单位：个", "made in x", "不可抗力", "产品_R12"]
    good = ["EV100", "Golden lamp", "XC-200 pro", "Lamp 12V", "Bike", "POX-1", "灯具 A1"]
    df = spark.createDataFrame([(x, i < len(bad)) for i, x in enumerate([*bad, *good])], "m string, bad boolean")
    got = df.select("m", "bad", grid.is_non_product(F.col("m"), F.lit("thing"), F.lit("")).alias("is")).collect()
    assert [r.m for r in got if r["is"] != r.bad] == []
    long = "这是一段很长的中文说明文字它不是任何产品而只是合同中的一句话"
    one = lambda m, n: spark.range(1).select(grid.is_non_product(F.lit(m), F.lit(n), F.lit(""))).first()[0]
    assert one("", long) and not one("A1", long) and not one("", "short") and one("", "") and one("x", "Payment of it") is False


def test_product_rows(spark):
    from millrace.operators import grid

    bad = [("payment: T/T", "", ""), ("Date 2024", "", "5"), ("订单编号 1", "", ""), ("发票号 2", "", "9"), ("Certificate of origin", "3", "7"), ("供应商 x", "", ""), ("3. insurance", "", ""), ("PO-240101", "", ""), ("", "5", "5"), ("x" * 201, "1", "1"), ("装箱明细", "", "3"), ("quality report", "", ""), ("plain words", "", ""), ("100以下", "", "")]
    good = [("EV12", "", ""), ("plain words", "5 pcs", ""), ("plain words", "", "0.15/片"), ("Golden Lamp", "", ""), ("lamp (red)", "", ""), ("AB/-", "", "")]
    df = spark.createDataFrame([(*x, i >= len(bad)) for i, x in enumerate([*bad, *good])], "f string, q string, p string, want boolean")
    got = df.select("f", "want", grid.is_product_row(F.col("f"), F.col("q"), F.col("p")).alias("is")).collect()
    assert [r.f for r in got if bool(r["is"]) != r.want] == []


@pytest.mark.parametrize("rows_per_range, gap", [(10_000, 30.0), (40, 30.0), (7, 0.5), (25, 500.0), (1, 30.0)])
def test_debounce_over_ranges(spark, rows_per_range, gap):
    """A path with two thirds of all events spreads over ranges, sparse and dense ones, and the walk goes on through them."""
    import datetime

    from millrace.operators.debounce import debounce

    rng, start = random.Random(2), datetime.datetime(2024, 1, 1)
    n = 1500 if rows_per_range > 1 else 60
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None, ""]), start + datetime.timedelta(milliseconds=250 * rng.randrange(8 * n)) if rng.random() > 0.02 else None, "more") for i in range(n)]
    want, last = [], {}
    for i, p, t, _ in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if p not in last or (t - last[p]).total_seconds() >= gap:
            want.append(i)
            last[p] = t
    df = spark.createDataFrame(rows, "id long, path string, ts timestamp, __range string").withColumnRenamed("__range", "more")
    got = debounce(df, "path", "ts", "id", gap, rows=rows_per_range)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want)
    assert debounce(df.limit(0), "path", "ts", "id", gap).count() == 0


def test_debounce_steps():
    import numpy as np

    from millrace.operators.debounce import steps

    times = np.array([0, 3, 10, 11, 25, 40])
    assert [x.tolist() for x in steps(times, 10)] == [[10], [40]]
    rng = np.random.default_rng(1)
    for _ in range(50):
        times, gap = np.sort(rng.integers(0, 300, 80)), int(rng.integers(1, 60))
        upto, last = steps(times, gap)
        for free in range(int(times[0]), int(times[0]) + gap + 1):
            walk, t = None, free
            while (i := int(np.searchsorted(times, t))) < len(times):
                walk, t = times[i], times[i] + gap
            k = int(np.searchsorted(upto, free))
            assert (k == len(upto) and walk is None) or last[k] == walk


def test_debounce_state_expires(spark, tmp_path):
    import datetime

    from millrace.streaming import streams

    start, schema = datetime.datetime(2024, 1, 1), "id long, path string, ts timestamp"
    for k, rows in enumerate([[(i, f"p{i}", start) for i in range(50)], [(100, "late", start + datetime.timedelta(days=10))], [(101, "late", start + datetime.timedelta(days=20))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = streams.debounced(streams.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), 60.0)
        q = q.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 2  # of 51 paths


def test_jdbc_reads_a_users_rows_in_parts(spark):
    import uuid

    from millrace.sources import catalog

    url, driver = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(i, f"u{i % 3}") for i in range(100)], "id long, user_id string")
    rows.coalesce(1).write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "products").option("createTableColumnTypes", "user_id VARCHAR(8)").save()
    back = catalog.read_jdbc(spark, url, "products", "u1", bounds=(0, 100), partitions=4, driver=driver)
    assert back.rdd.getNumPartitions() == 4 and sorted(r[0] for r in back.collect()) == list(range(1, 100, 3))


@pytest.mark.parametrize("low, high, parts", [(0, 99, 4), (5, 5, 4), (-7, 3, 3), (None, None, 4), (0, 9, 1)])
def test_id_ranges_part_all_rows(spark, low, high, parts):
    from millrace.sources import catalog

    ids = spark.createDataFrame([(i,) for i in [None, -100, 1000, *range(low or 0, (high or 0) + 1)]], "id long")
    found = [ids.where(r).count() for r in catalog.id_ranges("id", low, high, parts)]
    assert sum(found) == ids.count()


def plain_loop(text, words):
    for old, new in sorted(words.items(), key=lambda kv: -len(kv[0])):
        text = text.replace(old, new)
    return text


@pytest.mark.parametrize("seed", range(6))
def test_translation_equals_a_loop_over_the_words(spark, seed):
    """Words that overlap, hold each other or arise from what was put in."""
    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abc型号") for _ in range(r.randint(1, n)))
    words = {piece(4): piece(3) for _ in range(30)}
    texts = [piece(25) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [x.en for x in G.translate_column(df, "t", "en", words).orderBy("i").collect()]
    assert got == [t and plain_loop(t, words) for t in texts[:-2]] + ["", None]


def test_dictionary_of_the_stated_size(spark):
    """20,000 words from a table, both ways."""
    signs = [chr(0x4E00 + i) for i in range(200)]
    table = spark.createDataFrame([(a + b, f"<{i} {k}>") for i, a in enumerate(signs) for k, b in enumerate(signs[:100])], "zh string, en string")
    words = G.word_table(table)
    assert len(words) == 20_000
    texts = ["".join(signs[(7 * i + 3 * k * k) % 200] for k in range(40)) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [x.en for x in G.translate_column(df, "t", "en", words).orderBy("i").collect()]
    assert got == [plain_loop(t, words) for t in texts]
    back = [x.zh for x in G.translate_column(spark.createDataFrame([(0, "<0 1> <5 7>")], "i int, t string"), "t", "zh", G.turned(words)).collect()]
    assert back == [f"{signs[0]}{signs[1]} {signs[5]}{signs[7]}"]


def test_translated_frame(spark):
    df = spark.createDataFrame([(1, "型号", None), (2, "红色 LED1", "x")], "`a.b` int, `型号 名称` string, `颜``色` string")
    out = G.translate_frame(df, G.WORDS)
    assert out.columns == ["a.b", "Model Name", "颜`色"] and [tuple(r) for r in out.orderBy(out.columns[1]).collect()] == [(1, "Model", None), (2, "Red LED1", "x")]


def test_dictionary_from_a_table(spark):
    words = G.word_table(spark.createDataFrame([("灯", "lamp"), ("灯具", "lighting"), (None, "x"), ("", "y"), ("灯", "light")], "zh string, en string"))
    assert words == {"灯": "lamp", "灯具": "lighting"}
    df = spark.createDataFrame([("灯具 灯 LED1 ABC",), (None,)], "t string")
    assert [r.en for r in G.translate_column(df, "t", "en", words | {"ABC": "x", "LED": "y"}, protect=True).collect()] == ["lighting lamp LED1 ABC", None]
    with pytest.raises(ValueError):
        G.word_table(spark.createDataFrame([("a", "b"), ("c", "d")], "zh string, en string"), most=1)
