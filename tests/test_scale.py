"""Work that must not grow faster than its input: what goes through the driver, what is worked out several times a row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators.history import handled
from millrace.plans import q_library, q_streams, registry
from tests.test_queries import QUERIES, SF


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["image_match_folder", "image_match_row", "image_match_scored", "image_match_name", "image_match_source", "image_match_page"])
def test_images_send_no_table_through_the_driver(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["spec_to_map", "format_spec", "parse_spec_dict"])
def test_texts_are_dealt_out(spark, name):
    assert "RoundRobinPartitioning" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize(("name", "step", "times"), [("spec_to_map", "regexp_extract(", 2), ("format_spec", "split(", 4), ("parse_spec_dict", "translate(", 1), ("clean_price", "regexp_extract_all(", 1), ("price_from_value", "regexp_extract(", 5)])
def test_a_step_is_worked_out_once(spark, name, step, times):
    assert plan(QUERIES[name](spark, SF), "optimizedPlan").count(step) <= times


def test_export_takes_the_first_ids_as_texts(spark):
    p = registry.load(spark, SF, "products").limit(1).drop("id", "user_id").crossJoin(spark.range(10_050)).selectExpr("*", "'local' AS user_id")
    assert sorted(r.id for r in q_library.csv_export_file(p).collect()) == sorted(str(n) for n in range(10_050))[:10_000]


def test_many_sessions_are_counted_exactly(spark):
    e = spark.range(30_000).selectExpr("id", "'view' AS event", "CAST(id % 15000 AS STRING) AS session_id", "'' AS payload", "timestamp_seconds(1704153600 + id % 600) AS created_at")
    got = {(r.span, r.first, r.sessions) for r in q_streams.stream_sessions_sketched(e).collect()}
    assert got == {("day", str(dt.date(2024, 1, 2)), 15_000), ("week", str(dt.date(2024, 1, 1)), 15_000)}


def test_paths_of_a_range_are_walked_at_once():
    free = {"b": 7}
    assert handled(["a", "b", None, "a", "b", None, "a"], [1, 2, 3, 4, 7, 8, 11], 5, free) == [0, 2, 4, 5, 6]
    assert free == {"a": 16, "b": 12, None: 13}


def test_quotation_lines_of_invoices_are_numbered_once(spark):
    assert "row_number" not in plan(QUERIES["invoice_sheet_rows"](spark, SF))


def test_cells_of_invoices_are_dealt_once(spark):
    from millrace.operators.invoices import invoice_sheet_rows

    cells = spark.range(4).selectExpr("'a' AS file", "'s' AS sheet", "CAST(id AS INT) AS row_no", "1 AS col_no", "'AB-1' AS value")
    assert plan(invoice_sheet_rows(cells)).count("Exchange") == 1


def test_tables_are_staged_in_parts(spark):
    from millrace.sources.staging import SHUFFLE_CLEANUP, staged_in_parts

    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(1000).selectExpr("IF(id % 10 = 0, NULL, id % 10) AS k", "id")
    out = staged_in_parts(lambda r: r.groupBy("k").agg(F.count("id").alias("n")), rows, "parts", "k")
    assert sorted((r.k or 0, r.n) for r in out.collect()) == [(k, 100) for k in range(10)]
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
    assert staged_in_parts(lambda r: r, rows.limit(0), "parts", "k").count() == 0
