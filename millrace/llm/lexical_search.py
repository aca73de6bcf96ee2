"""Ranked lexical search over hashed max-sketches.

The index keeps, of each document, its distinct terms with their frequencies (a forward index) and a sketch of fixed
width: terms are hashed to its places and each place keeps the largest frequency that fell on it. A term's impact grows
with its frequency and falls with the document's length alone, so a place's impact is at least that of every term on it,
and the sum of a query's weights times the impacts at its terms' places is an upper bound of its score. As the sketch
holds frequencies, not impacts, it stays valid when documents are added and the averages move.

Queries are answered in blocks: one matrix product of a batch's impacts and the block's weights gives all bounds; then,
query by query, documents are scored exactly in descending order of their bound until the next bound is below the score
of the worst that still counts. That limit is the task's own tenth best or, if higher, the tenth best of a sixteenth of
the files, which is searched first: a tenth best of any part is a lower limit for the whole. No document is skipped
whose bound reaches the limit, so the result is that of scoring all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, discard, stage

#: Places of a sketch; more make bounds tighter and sketches longer.
WIDTH = 2048
#: Queries that are answered in one pass over the index.
BLOCK = 256
#: One of so many files of the index is searched first, for the limits with which the whole is searched.
FIRST_FILES = 16
#: A frequency of so much or more is kept as this, and its impact taken for the largest that there is.
MANY = 255
#: Impacts are below this, whatever the frequency.
MOST_IMPACT = 1_000_000

#: A-Z to a-z; all ASCII but letters and digits to blanks. UTF-8 writes all other characters in bytes from 0x80 on.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: int, docs: int, words: int) -> int:
    """m of a document of n terms, in Python's whole numbers, which don't overflow."""
    return 100 - 90 + (90 * n * docs) // words


def sketches(documents: list[Counter], width: int) -> np.ndarray:
    """Largest frequency at each place, a row a document."""
    out = np.zeros((len(documents), width), dtype=np.uint8)
    for row, c in zip(out, documents, strict=True):
        at = np.fromiter(map(crc32, c), dtype=np.int64, count=len(c)) % width
        np.maximum.at(row, at, np.minimum(np.fromiter(c.values(), dtype=np.int64, count=len(c)), MANY).astype(np.uint8))
    return out


def sketch_index(docs: DataFrame, *, text="text", doc_id="doc_id", width: int = WIDTH) -> DataFrame:
    """doc_id, n (terms with repeats), sketch, terms (parted by blanks) and freqs of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms(t)) for t in batch.column("t").to_pylist()]
            some = [i for i, c in enumerate(counted) if c]
            own = [counted[i] for i in some]
            columns = [
                batch.column("doc_id").take(pa.array(some, pa.int64())),
                pa.array([c.total() for c in own], pa.int64()),
                pa.array([s.tobytes() for s in sketches(own, width)], pa.binary()),
                pa.array([b" ".join(c) for c in own], pa.binary()),
                pa.array([np.fromiter(c.values(), dtype=np.int64, count=len(c)).tobytes() for c in own], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sketch", "terms", "freqs"])

    d = bounded_batches(docs).where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    kinds = [("doc_id", docs.schema[doc_id].dataType), ("n", T.LongType()), ("sketch", T.BinaryType()), ("terms", T.BinaryType()), ("freqs", T.BinaryType())]
    return d.mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


class Queries:
    """A block of queries: their terms, weights, and the matrix from sketch places to queries."""

    def __init__(self, wanted: dict, width: int):
        self.ids = list(wanted)
        self.terms = [sorted(wanted[i]) for i in self.ids]
        self.width = width

    def weigh(self, df: dict[bytes, int], docs: int, words: int) -> None:
        self.docs, self.words = docs, words
        weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1))) for own in self.terms for t in own}
        self.weighted = [[(t, weight[t]) for t in own if t in df] for own in self.terms]
        places = sorted({crc32(t) % self.width for own in self.weighted for t, _ in own})
        self.places = np.array(places, dtype=np.int64)
        row = {p: i for i, p in enumerate(places)}
        self.matrix = np.zeros((len(places), len(self.ids)))
        for q, own in enumerate(self.weighted):
            for t, w in own:
                self.matrix[row[crc32(t) % self.width], q] += w

    def bounds(self, sketch: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds, a row a document and a column a query. All sums are whole numbers below 2^53 and so exact."""
        tf = sketch[:, self.places].astype(np.float64)
        most = np.floor(1e9 * tf / (1000 * tf + 8 * m[:, None]))
        most[tf >= MANY] = MOST_IMPACT
        return most @ self.matrix

    def score(self, q: int, freq: dict[bytes, int], m: int) -> int:
        return sum(w * impact(freq[t], m) for t, w in self.weighted[q] if t in freq)


def order(found: tuple) -> tuple:
    """Highest score first, then the smallest id, null last."""
    score, doc_id = found
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def best_of(batches: Iterator[pa.RecordBatch], queries: Queries, floors: list[int], top: int) -> list[list[tuple]]:
    """A task's best documents for each query of the block."""
    best: list[list[tuple]] = [[] for _ in queries.ids]
    floors = list(floors)
    for batch in batches:
        ids, blobs, counts = (batch.column(c) for c in ("doc_id", "terms", "freqs"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, queries.width)
        norms = [length_norm(n, queries.docs, queries.words) for n in batch.column("n").to_pylist()]
        bounds = queries.bounds(sketch, np.array(norms, dtype=np.float64))
        seen: dict[int, dict[bytes, int]] = {}
        for q, found in enumerate(best):
            bound = bounds[:, q]
            some = np.flatnonzero(bound >= floors[q])
            for i in some[np.argsort(-bound[some], kind="stable")].tolist():
                if bound[i] < floors[q]:
                    break
                if i not in seen:
                    seen[i] = dict(zip(blobs[i].as_py().split(), np.frombuffer(counts[i].as_py(), np.int64).tolist(), strict=True))
                score = queries.score(q, seen[i], norms[i])
                if score >= floors[q]:
                    found.append((score, ids[i].as_py()))
                    if len(found) >= 4 * top or floors[q] == 1 and len(found) == top:
                        found.sort(key=order)
                        del found[top:]
                        floors[q] = max(floors[q], found[-1][0])
            if len(found) > top:
                found.sort(key=order)
                del found[top:]
                floors[q] = max(floors[q], found[-1][0])
    return [sorted(found, key=order)[:top] for found in best]


def frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each wanted term; terms that none holds are left out."""
    shared = index.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for blob in batch.column("terms").to_pylist():
                held.update(shared.value.intersection(blob.split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])

    counts = index.select("terms").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in counts.collect()}  # at most one row a term of the block


def ranked(index: DataFrame, queries: Queries, floors: list[int], top: int, item_kind: T.DataType) -> DataFrame:
    """item_id, rank, doc_id, score of a block: each task's best, merged."""
    shared = index.sparkSession.sparkContext.broadcast((queries, floors))
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", item_kind), T.StructField("doc_id", index.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, limits = shared.value
        best = best_of(batches, block, limits, top)
        rows = [(q, block.ids[q], doc, score) for q, found in enumerate(best) for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else repeat([], 4), arrow, strict=True)], schema=arrow)

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return index.mapInArrow(run, schema).withColumn("rank", place).where(F.col("rank") <= top)


def search_block(index: DataFrame, items: dict, docs: int, words: int, top: int, width: int, first_files: int, item_kind: T.DataType) -> DataFrame:
    spark = index.sparkSession
    queries = Queries(items, width)
    queries.weigh(frequencies(index, {t for own in queries.terms for t in own}), docs, words)
    floors, files = [1] * len(queries.ids), sorted(index.inputFiles())
    if len(files) > first_files:
        first = ranked(spark.read.schema(index.schema).parquet(*files[::first_files]), queries, floors, top, item_kind)
        for r in first.where(F.col("rank") == top).select("q", "score").collect():  # at most one row a query of the block
            floors[r.q] = r.score
    return ranked(index, queries, floors, top, item_kind).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, text="text", doc_id="doc_id", item_text="text", item_id="item_id", top: int = 10, width: int = WIDTH, block: int = BLOCK, first_files: int = FIRST_FILES) -> DataFrame:
    """The `top` documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    Documents without a term (null, empty, marks alone) count nowhere. Repeated rows of documents are ranked each; equal
    scores by ascending id, null last. Rows of one item_id are one item with the terms of all of them (a null id is an
    item too); items without terms or without hits have no rows. No documents or no items give an empty table. Other
    columns, whatever their names, are left out. Texts of any length are read whole.
    """
    spark, item_kind = docs.sparkSession, items.schema[item_id].dataType
    index = stage(sketch_index(docs, text=text, doc_id=doc_id, width=width), "sketches")
    n_docs, n_words = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("t")).distinct()
    asked = stage(asked.withColumn("h", F.xxhash64(F.col("item_id").cast("string"))), "items")
    blocks = -(-asked.select("item_id").distinct().count() // block)
    parts = []
    for k in range(blocks if n_docs else 0):
        own: dict = {}
        for r in asked.where(F.pmod("h", F.lit(blocks)) == k).toLocalIterator():
            own.setdefault(r.item_id, set()).update(terms(bytes(r.t)))
        own = {i: t for i, t in own.items() if t}
        if own:
            parts.append(stage(search_block(index, own, n_docs, n_words, top, width, first_files, item_kind), "ranked"))
    discard(index, asked)
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, parts)
