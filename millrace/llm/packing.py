"""Harmonic packing of tokenised documents into sequences.

A piece of a document belongs to class k if k such pieces fill a sequence: its length is at most capacity/k and k times
it leaves no more than SLACK of the sequence empty. A document gives whole sequences first; what remains is one piece if
it fits a class that well, else it is cut at the length of the next class. So every bin of class k takes exactly k
pieces, whatever they are, and workers fill bins without knowing of each other.

Pieces that a task has left over, fewer than k a class, are numbered through over all tasks (a running sum of counts per
task) and fill bins of their class in the same way. What is then left is fewer than k pieces a class over the whole
table, a constant of about 16,000 pieces at most; they are packed in one task, longest first.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stage, text_id
from .words import blocks, split_words

CAPACITY = 2048
SLACK = 1 / 64
BLOCK = 4_000_000
CACHE = 250_000


def cut(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= capacity * (1 - slack):
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


MARK, ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
MARK[list(b".,;:!?")] = True
ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


class Known:
    """Ids by word, in two generations: when the younger is full the older is dropped, so that words that recur stay."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, words: list[bytes]) -> list[bytes | None]:
        young, old = self.young.get, self.old.get
        out = [young(w) for w in words]
        if self.old:
            for i, x in enumerate(out):
                if x is None and (x := old(words[i])) is not None:
                    self.young[words[i]] = out[i] = x
        return out

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Encoder:
    """Token ids of texts. The tokenizer drops white space and never joins across it, so that each distinct word is
    encoded once and the ids of a text are those of its words in turn. It also lower-cases, and it parts marks from
    letters and digits, so both are done before words are told apart."""

    def __init__(self, path: str, most: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(most)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        found = self.known.find(words)
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            texts = [words[i].decode() for i in fresh]
            letters = [k for k, t in enumerate(texts) if t.isalpha()]
            ids = self.encode_joined([texts[k] for k in letters])
            if ids is None:
                letters, ids = [], []
            for k, x in zip(letters, ids, strict=True):
                found[fresh[k]] = x
            rest = [k for k in range(len(fresh)) if found[fresh[k]] is None]
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                found[fresh[k]] = array("I", e.ids).tobytes()
            self.known.young.update((words[i], found[i]) for i in fresh)
        self.known.turn()
        return found

    def encode_joined(self, texts: list[str], together: int = 200) -> list[bytes] | None:
        """Ids of words of letters, encoded many at a time: each is one piece whose last id, and no other, stands for a
        word's end. None if the ends don't number the words."""
        lines = [" ".join(texts[at : at + together]) for at in range(0, len(texts), together)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), dtype=np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(texts) or (len(ids) and ends[-1] != len(ids)):
            return None
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in itertools.pairwise(at)]

    def texts(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, then end."""
        codes, starts, distinct = split_words(parted([t.encode() for t in texts]))
        ids = [*self.ids_of(list(distinct)), array("I", [end]).tobytes()]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), np.uint32), np.concatenate([[0], np.cumsum(size)[:-1]])
        # the end token as a last word of each text
        codes = np.insert(codes, starts[1:], len(ids) - 1)
        starts = starts + np.arange(len(starts))
        n = size[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        every = flat[np.repeat(at[codes] - upto[:-1], n) + np.arange(upto[-1])]
        return [every[a:b] for a, b in zip(upto[starts[:-1]], upto[starts[1:]], strict=True)]


def parted(texts: list[bytes]) -> list[bytes]:
    """Texts in lower case (A-Z) with a space between a letter or digit and a mark after it. Texts that may hold a
    special token stay as they are."""
    plain = [i for i, t in enumerate(texts) if b"<|" not in t]
    joined = b" ".join([texts[i] for i in plain]).lower()
    at = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(MARK[at[1:]] & ALNUM[at[:-1]]) + 1 if len(at) else np.zeros(0, dtype=np.int64)
    joined = np.insert(at, gaps, 32).tobytes()
    stops = np.cumsum([len(texts[i]) + 1 for i in plain]) - 1
    stops = stops + np.searchsorted(gaps, stops)
    out, begin = list(texts), 0
    for i, stop in zip(plain, stops.tolist(), strict=True):
        out[i] = joined[begin:stop]
        begin = stop + 1
    return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker, which keeps what it knows from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def fill_local(path: str, end: int, capacity: int, slack: float, block: int):
    """Pieces; those of full bins with their sequence and offset, the rest with class, task and number in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own, task = encoder(path), TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = defaultdict(list)
        made = task << 36
        for pdf in blocks(batches, "t", block, join=True):
            rows = []
            for doc, ids in zip(pdf["doc_id"], own.texts(list(pdf["t"]), end), strict=True):
                start = 0
                for n, k in cut(len(ids), capacity, slack):
                    piece = (doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids))
                    start += n
                    full = waiting[k]
                    full.append(piece)
                    if len(full) == k:
                        offset = 0
                        for p in full:
                            rows.append((*p, made, offset, None, None, None))
                            offset += p[2]
                        made += 1
                        waiting[k] = []
            yield pd.DataFrame(rows, columns=[*PIECE, "class", "task", "slot"])
        rows = [(*p, None, None, k, task, i) for k, left in sorted(waiting.items()) for i, p in enumerate(left)]
        yield pd.DataFrame(rows, columns=[*PIECE, "class", "task", "slot"])

    return run


def pack_rest(capacity: int):
    """Longest first into the first sequence with room; at most capacity tokens of each class come here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "class", "rank"], ascending=[False, True, True])
        used: list[int] = []
        ids, offsets, first = [], [], 0
        for n in pdf["length"]:
            while first < len(used) and used[first] == capacity:
                first += 1
            at = next((i for i in range(first, len(used)) if used[i] + n <= capacity), len(used))
            if at == len(used):
                used.append(0)
            ids.append((3 << 60) + at)
            offsets.append(used[at])
            used[at] += n
        return pdf.assign(sequence_id=ids, offset=offsets)[PIECE]

    return run


def pack(docs: DataFrame, *, tokenizer: str, text="text", doc_id="doc_id", end: int = 1, capacity: int = CAPACITY, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and then the end id, so null and empty texts have one token. Rows that repeat an id
    are packed each for itself. Longer texts than a sequence fill whole sequences first. An empty table gives an empty
    table. Other columns of docs are left out. Sequence numbers are distinct, not consecutive.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    d = bounded_batches(docs).select(text_id(doc_id), F.coalesce(text, F.lit("")).alias("t"))
    piece = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = stage(d.mapInPandas(fill_local(tokenizer, end, capacity, slack, block), f"{piece}, class int, task int, slot int"), "packing-pieces")
    local = pieces.where("sequence_id is not null").select(*PIECE)
    left = pieces.where("sequence_id is null")

    per_task = left.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("before", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    per_task = per_task.withColumn("n", F.sum("n").over(Window.partitionBy("class")))
    per_task = per_task.select(F.col("class").alias("c"), F.col("task").alias("k"), "n", "before")
    left = left.join(per_task, (F.col("class") == F.col("c")) & (F.col("task") == F.col("k")))
    left = left.withColumn("rank", F.col("before") + F.col("slot"))
    left = stage(left.withColumn("bin", F.floor(F.col("rank") / F.col("class"))), "packing-left")
    whole = F.col("bin") < F.floor(F.col("n") / F.col("class"))
    in_bin = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    second = left.where(whole).withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
    second = second.withColumn("sequence_id", F.lit(1 << 61) + F.col("class").cast("long") * F.lit(1 << 40) + F.col("bin"))
    third = left.where(~whole).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(pack_rest(capacity), piece)
    out = local.unionByName(second.select(*PIECE)).unionByName(third)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
