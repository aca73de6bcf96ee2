"""Lexical search against a plain scan, its bounds, and odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search as L
from millrace.llm import registry
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    """(item, rank, id, score) by scoring all documents."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * c.total() * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "Red fox"), (2, "red FOX fox"), (3, None), (4, ""), (5, " ,.-"), (6, "Ünder ÜNDER under x1_y2"), (6, "Ünder ÜNDER under x1_y2"), (None, "red fox"), (7, "red fox"),
    (8, "hot " * 70_000 + "fox"), (9, "a" * 200_000 + " cold"), (10, "NUL\x00in\x7fside"), (2**60 + 1, "red"),
]
ITEMS = [(1, "fox, FOX red"), (2, None), (3, "--"), (4, "nowhere"), (5, "Ünder y2"), (5, "cold"), (5, "cold"), (None, "hot"), (6, "nul side"), (7, "a" * 200_000)]


@pytest.mark.parametrize("options", [{}, {"width": 1}, {"width": 7, "block": 2, "first_files": 2}, {"top": 2, "first_files": 1}])
def test_odd_tables(spark, options):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in DOCS], "doc_id long, text string, `sk``etch` string, terms long").repartition(5)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id int, text string, doc_id int")
    got = sorted((tuple(r) for r in L.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(DOCS, ITEMS, options.get("top", 10))


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    got = L.search(docs, spark.createDataFrame([("q", "x")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


def test_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id in (3, 4)"), items), (docs, items.where("item_id in (2, 3)"))):
        out = L.search(d, i)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_cut(spark):
    """No score is above its bound, and bounds spare most documents the exact scoring."""
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counted = [c for c in (Counter(L.terms(t.encode())) for t in texts) if c]
    items = {r.item_id: set(L.terms(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    q = L.Queries(items, L.WIDTH)
    n, words = len(counted), sum(c.total() for c in counted)
    q.weigh(Counter(t for c in counted for t in c), n, words)
    m = [L.length_norm(c.total(), n, words) for c in counted]
    bounds = q.bounds(L.sketches(counted, L.WIDTH), np.array(m, dtype=float))
    scores = np.array([[q.score(k, c, x) for k in range(len(q.ids))] for c, x in zip(counted, m)])
    assert (bounds >= scores).all()
    tenth = np.sort(scores, axis=0)[-10]
    assert (bounds >= tenth).mean() < 0.7


def test_many_equal_scores_and_blocks(spark):
    """Hundreds of copies tie: the smallest ids come first, in whatever partition."""
    data = [(i, "same words here" if i % 3 else f"other words {i}") for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(13, F.rand(3))
    asked = [(k, "same here") for k in range(9)]
    got = sorted((tuple(r) for r in L.search(docs, spark.createDataFrame(asked, "item_id int, text string"), block=2, first_files=3).collect()), key=str)
    assert got == plain(data, asked)


def test_query(spark):
    got = registry.op12_lexical_search(spark, SF).toPandas()
    assert rows(got) == rows(duck(SF, registry.SQL_OP12)) and len(got)
