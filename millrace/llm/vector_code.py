"""Vector code compression: a product quantiser that remembers grid cells.

Vectors become whole numbers and are cut into equal parts; each part has a codebook, fitted by rounds of assigning and
averaging in whole numbers, so that every run and every cut of the table into tasks gives the same books.

An assignment need not look at all entries of a book. A part's point lies in a cell of a coarse grid; an entry that by
smallest and largest distances loses to another one everywhere in the cell's box can be nearest to no point in it. The
entries that are left are found once for each cell and kept in the task under the cell's hash; points are then compared
exactly with those alone. Cells whose hashes clash are told apart by their coordinates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Side of a grid cell, in scaled units.
SIDE = 768
#: Cells that a task remembers for a part; then it starts afresh.
CELLS = 200_000
#: Up to here squares and their sums stay in 64 bits for parts of up to 256 components; larger numbers are Python's.
PLAIN = 1 << 27
#: Sums leave a task in pieces of so many bits, so that Spark's sums are exact whatever the numbers' size.
PIECE = 48

Books = list[list[list[int]]]
"""By part and entry, the components."""


def whole(x: float) -> int:
    """floor(SCALE * x); the product is exact, as SCALE is a power of two, unless it overflows, and then x is whole."""
    y = SCALE * x
    return math.floor(y) if math.isfinite(y) else int(x) * SCALE


def points(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers: 64 bits if they all fit in PLAIN, else Python's."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not x.size or np.abs(x).max() * SCALE < PLAIN:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([whole(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def open_entries(cells: np.ndarray, book: np.ndarray, side: int) -> np.ndarray:
    """For each cell which entries may be nearest to a point in its box.

    f is the entry whose largest distance to the box is smallest. Another one, e, is out if its smallest distance is
    above that, or already if d(e) - d(f), which is linear in the point, is above 0 at its smallest in the box.
    """
    low = (cells * side)[:, None, :]
    high = low + side - 1
    near = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    near, far = (near * near).sum(axis=2), (far * far).sum(axis=2)
    f, least = far.argmin(axis=1), far.min(axis=1)
    slope = book[f][:, None, :] - book
    gap = 2 * np.where(slope > 0, low * slope, high * slope).sum(axis=2) + (book * book).sum(axis=1) - (book * book).sum(axis=1)[f][:, None]
    return (near <= least[:, None]) & (gap <= 0)


class Part:
    """One part's codebook and the cells seen so far."""

    def __init__(self, book: list[list[int]], side: int = SIDE, most_cells: int = CELLS):
        wide = max(abs(v) for e in book for v in e) >= PLAIN
        self.book = np.array(book, dtype=object if wide else np.int64)
        self.side, self.most_cells = side, most_cells
        self.odd = np.random.default_rng(5).integers(0, 1 << 63, self.book.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.cells = np.zeros((0, self.book.shape[1]), dtype=np.int64)
        self.open = np.zeros((0, len(self.book)), dtype=bool)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Which entries each point has to be compared with."""
        cell = x // self.side
        hashed = (cell.astype(np.uint64) * self.odd).sum(axis=1, dtype=np.uint64)
        kinds, first, of = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.place) + len(kinds) > self.most_cells:
            self.forget()
        at = np.fromiter((self.place.get(h, -1) for h in kinds.tolist()), dtype=np.int64, count=len(kinds))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.cells), len(self.cells) + len(new))
            self.place.update(zip(kinds[new].tolist(), at[new].tolist(), strict=True))
            self.cells = np.concatenate([self.cells, cell[first[new]]])
            self.open = np.concatenate([self.open, open_entries(cell[first[new]], self.book, self.side)])
        row = at[of.ravel()]
        out = self.open[row]
        out[(self.cells[row] != cell).any(axis=1)] = True  # another cell with the same hash
        return out

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point; of equally near entries the first."""
        if x.dtype == object or self.book.dtype == object:
            d = ((x.astype(object)[:, None, :] - self.book.astype(object)) ** 2).sum(axis=2)
            best = [min(range(d.shape[1]), key=lambda e, row=row: (row[e], e)) for row in d]
            return np.array(best, dtype=np.int64), d[np.arange(len(best)), best]
        among = self.candidates(x)
        best, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.book):
            rows = np.flatnonzero(among[:, e])
            d = x[rows] - entry
            d = (d * d).sum(axis=1)
            nearer = d < least[rows]
            least[rows[nearer]], best[rows[nearer]] = d[nearer], e
        return best, least


def pieces(v: int) -> Iterator[tuple[int, int]]:
    """v as (place, piece): the sum of piece * 2^(PIECE * place)."""
    place = 0
    while not -(1 << 62) < v < 1 << 62:
        yield place, v & ((1 << PIECE) - 1)
        v, place = v >> PIECE, place + 1
    yield place, v


def partial_sums(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    """A task's points of each entry, added up by component; component -1 counts them."""
    own, step = [Part(b) for b in books], len(books[0][0])
    total = np.zeros((len(books), len(books[0]), step + 1), dtype=object)
    for batch in batches:
        x = points(batch.column("x"), step * len(books))
        for p, part in enumerate(own):
            mine = x[:, p * step : (p + 1) * step]
            best, _ = part.assign(mine)
            for e in np.unique(best):
                rows = mine[best == e]
                total[p, e, :step] += rows.sum(axis=0).astype(object)
                total[p, e, step] += len(rows)
    rows = [(p, e, c if c < step else -1, place, v) for (p, e, c), s in np.ndenumerate(total) if total[p, e, step] for place, v in pieces(int(s))]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int32()] * 4 + [pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "component", "place", "v"])


def fit_codebooks(vectors: DataFrame, books: Books, rounds: int) -> Books:
    """Books after some rounds over vectors(x); what is collected has a row a component, part and entry."""
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        sums = vectors.select("x").mapInArrow(lambda b, s=shared: partial_sums(b, s.value), "part int, entry int, component int, place int, v long")
        sums = sums.groupBy("part", "entry", "component", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        total: dict[tuple[int, int, int], int] = {}
        for r in sums.collect():
            key = (r.part, r.entry, r.component)
            total[key] = total.get(key, 0) + (int(r.v) << (PIECE * r.place))
        books = [[[total[p, e, c] // total[p, e, -1] for c in range(len(entry))] if (p, e, -1) in total else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
    return books


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """vectors(vec_id, label, x) as vec_id, label, code (two hex digits a part), error (null beyond 64 bits)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = [Part(b) for b in shared.value], len(shared.value[0][0])
        for batch in batches:
            x = points(batch.column("x"), step * len(own))
            each = [part.assign(x[:, p * step : (p + 1) * step]) for p, part in enumerate(own)]
            digits = np.stack([best for best, _ in each], axis=1).astype(np.uint8)
            errors = sum(d.astype(object) for _, d in each)
            errors = [e if e < 1 << 63 else None for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = [*vectors.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return vectors.select("vec_id", "label", "x").mapInArrow(run, T.StructType(kinds))


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def compress(df: DataFrame, *, vec_id="vec_id", vector="embedding", label="label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (errors of the label's rows added up), codebooks_sha256 of each usable row.

    Null vectors and those with a null, infinite or not-a-number component are dropped. The books begin with the first
    `entries` rows by vec_id (null last, then by vector), fewer if there are fewer. Rows that repeat an id or a vector
    are coded each. All vectors have the length of the first one that can be cut into equal parts; a row of another
    length can't be compared and keeps its place with null code and error. Errors beyond 64 bits are null. Null labels
    are one label. An empty table gives an empty one. Other columns, whatever their names, are left out.
    """
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = bounded_batches(df).where(F.col(vector).isNotNull() & sound)
    kept = stage(kept.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")), "vectors")
    cut = (F.size("x") > 0) & (F.size("x") % parts == 0)
    by_id = (F.asc_nulls_last("vec_id"), "x")
    head = kept.where(cut).orderBy(*by_id).first()
    if head is None:
        out, books = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    else:
        width = len(head.x)
        same = kept.where(F.size("x") == width)
        start = [[whole(v) for v in r.x] for r in same.orderBy(*by_id).limit(entries).collect()]
        step = width // parts
        books = fit_codebooks(same, [[row[p * step : (p + 1) * step] for row in start] for p in range(parts)], rounds)
        out = encode(same, books).unionByName(kept.where(F.size("x") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    out = stage(out, "codes")
    by_label = stage(out.groupBy(F.col("label").alias("__label")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error")), "label-errors")
    discard(kept)
    return out.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
