"""Each query of the library against its SQL."""

import pytest

from millrace.plans import registry
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck(SF, SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) == len(set(got.columns))


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_debounce_stream_equals_batch(spark):
    stream, batch = (QUERIES[n](spark, SF).toPandas() for n in ("stream_debounce", "stream_debounce_batch"))
    assert rows(stream) == rows(batch)
    assert 0 < len(batch)
