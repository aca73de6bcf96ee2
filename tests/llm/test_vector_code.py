"""Vector codes against whole-number brute force, and odd tables."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import registry
from millrace.llm import vector_code as V
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, `x` string, `co``de` int"


def brute(data, parts=8, entries=16, rounds=6):
    """(id, code, error, label_error, digest) of each kept row, in Python's whole numbers."""
    kept = [(i, x, label) for i, x, label in data if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next((len(x) for _, x, _ in kept if x and len(x) % parts == 0), 0)
    ints = [[V.whole(v) for v in x] for _, x, _ in kept]
    same = [x for x in ints if width and len(x) == width]
    step = width // parts

    def near(book, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    books = [[x[p * step : (p + 1) * step] for x in same[:entries]] for p in range(parts)] if same else []
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for x in same:
                own = x[p * step : (p + 1) * step]
                groups[near(book, own)[0]].append(own)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(book)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for (i, _, label), x in zip(kept, ints):
        each = [near(b, x[p * step : (p + 1) * step]) for p, b in enumerate(books)] if width and len(x) == width else None
        error = sum(d for _, d in each) if each else None
        out.append([i, "".join(f"{e:02x}" for e, _ in each) if each else None, error if error is not None and error < 1 << 63 else None, label])
    total = defaultdict(lambda: None)
    for _, _, e, label in out:
        if e is not None:
            total[label] = (total[label] or 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def run(spark, data, cut=5, **options):
    d = spark.createDataFrame([(i, x, label, "c", 1) for i, x, label in data], SCHEMA).repartition(cut)
    return sorted((tuple(r) for r in V.compress(d, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(n, width, seed, spread=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, spread) for _ in range(width)] for _ in range(n)]


ODD = [(900, None, 1), (901, [0.5, None] + [0.1] * 14, 1), (902, [float("nan")] * 16, 1), (903, [float("-inf")] + [0.0] * 15, 1), (None, [0.25] * 16, None), (None, [0.25] * 16, None), (904, [1.0] * 24, 2), (905, [], 2), (906, [1.0] * 5, 3)]


def test_against_brute_force(spark):
    data = [(i, x, i % 4 if i % 5 else None) for i, x in enumerate(vectors(150, 16, 1))] + ODD + [(7, [0.25] * 16, 1)] * 30
    assert run(spark, data) == brute(data)


@pytest.mark.parametrize("options", [{"entries": 3, "rounds": 2}, {"parts": 2, "entries": 200}, {"rounds": 0}])
def test_other_sizes(spark, options):
    data = [(-i, x, i % 3) for i, x in enumerate(vectors(60, 16, 2, 30.0))]
    assert run(spark, data, **options) == brute(data, **options)


def test_huge_components(spark):
    """Numbers beyond 64 bits are coded exactly; errors that no long holds are null."""
    big = [(i, [v * 10.0 ** (3 * i % 40) for v in x], 0) for i, x in enumerate(vectors(40, 8, 3))]
    assert run(spark, big, cut=3) == brute(big)
    assert run(spark, [(1, [1e308] * 8, 1), (2, [-1e308] * 8, 1), (3, [0.0] * 8, 2)]) == brute([(1, [1e308] * 8, 1), (2, [-1e308] * 8, 1), (3, [0.0] * 8, 2)])


def test_few_rows(spark):
    assert run(spark, [(1, [0.5] * 8, 1)]) == brute([(1, [0.5] * 8, 1)])
    assert run(spark, [(1, [], 1), (2, [1.0], 1)]) == brute([(1, [], 1), (2, [1.0], 1)])
    assert run(spark, ODD[:3]) == []
    empty = V.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_cells_hold_every_nearest_entry():
    """Entries that a cell leaves out are never nearest, with ties, clashing hashes and a memory that overflows too."""
    rng = np.random.default_rng(4)
    for spread, side in ((300, 512), (2000, 512), (40, 64), (3, 2)):
        book, x = rng.integers(-spread, spread, (16, 4)), rng.integers(-spread, spread, (3000, 4))
        book[5] = book[2]
        d = ((x[:, None, :] - book) ** 2).sum(axis=2)
        for kind in ("plain", "clash", "full"):
            part = V.Part(book.tolist(), side, 40 if kind == "full" else V.CELLS)
            if kind == "clash":
                part.odd = part.odd * np.uint64(0)
            for k in range(0, 3000, 500):
                best, least = part.assign(x[k : k + 500])
                assert (best == d[k : k + 500].argmin(axis=1)).all() and (least == d[k : k + 500].min(axis=1)).all()


def test_cells_cut(spark):
    """On the table's vectors small cells leave half of the entries to compare, those of the usual size three quarters."""
    x = np.floor(np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]) * 4096).astype(np.int64)
    assert V.Part(x[:16, :8].tolist(), 512).candidates(x[:, :8]).mean() < 0.7 and V.Part(x[:16, :8].tolist()).candidates(x[:, :8]).mean() < 0.9


def test_query(spark):
    got = registry.op11_vector_code(spark, SF).toPandas()
    assert rows(got) == rows(duck(SF, registry.SQL_OP11)) and len(got)
