"""LM scoring with a weighted backoff automaton.

The model is an n-gram with Dirichlet priors, each order over the one below it:
P(w|h) = (c(hw) + MU * P(w|h')) / (c(h) + MU), h' being h without its first word, down to the add-one unigram
P(w) = (c(w)+1)/(N+V+1). As an automaton: every history of up to ORDER-1 words that training has seen is a state, with an
arc for each word seen after it; any other word takes the failure arc, weight MU/(c(h)+MU), to the state of h', and from
the root every word goes on. One traversal per text, from left to right, carries the state and adds up log10 weights.

No table of the model is gathered anywhere. Texts are read once, in blocks of BLOCK characters, and kept as word numbers.
What a block has to know are the training counts of its own words and arcs over all blocks. A block sends each of its
distinct words (arcs) once, as hashes with its own counts; hashes fall into ranges, each of which one task adds up, whatever the frequencies: a word that stands everywhere is one hash a block. What comes back is the total of each
hash that several blocks have. A word (arc) that one block alone has is known there already, and so is any arc made of
one: only arcs whose parts several blocks share are sent at all. Orders follow one another in this way; the traversal is
then a lookup in arrays.

Words and arcs are told apart by 64 bits of xxh3 beside their range, which comes from other bits: of a range's GROUP
entries two are taken for one with a chance below 1e-7.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, stage, text_id
from .words import blocks, split_words, sums

ORDER = 3
MU = (2000.0, 5.0)
BLOCK = 10_000_000
#: Entries that a range of hashes holds on average.
GROUP = 1_000_000
BLOCK_BITS = 24
#: No word contains white space, so this stands for the end of a text.
END = b" "
START_KEY = np.int64(1)


def hashed(words: np.ndarray) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """64 bits from two times 64 bits."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.uint64(b) if isinstance(b, int) else b.view(np.uint64))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, packed: the upper ones are nearly all zero."""
    return zlib.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """codes renumbered so that the most frequent get the smallest numbers, and the old number of each new one."""
    order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    new = np.empty(n, dtype=np.int64)
    new[order] = np.arange(n)
    return new[codes], order


BLOCKS = "block long, ids array<string>, held binary, starts binary, codes binary, words binary, n_train long, n_words long, n_starts long, n_tokens long"


def read_blocks(limit: int):
    """Each block of texts as one row: ids, which are held out, where texts begin, words by number, the words' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << BLOCK_BITS
        for pdf in blocks(batches, "t", limit, join=True):
            codes, starts, distinct = split_words([t.encode().lower() for t in pdf["t"]], END)
            codes, order = by_frequency(codes, len(distinct))
            held = pdf["held_out"].to_numpy(dtype=bool)
            n_train = int(np.diff(starts)[~held].sum())
            yield pd.DataFrame({
                "block": [block], "ids": [[None if pd.isna(x) else x for x in pdf["doc_id"]]], "held": [held.tobytes()], "starts": [planes(starts)], "codes": [planes(codes)], "words": [hashed(distinct[order]).tobytes()],
                "n_train": [n_train], "n_words": [len(distinct)], "n_starts": [int((~held).sum())], "n_tokens": [len(codes)],
            })
            block += 1

    return run


class Block:
    """A block's words and arcs, level by level: level 1 are words, level k arcs from histories of k-1 words."""

    def __init__(self, row: pd.Series):
        self.ids, self.held = row["ids"], np.frombuffer(row["held"], bool)
        self.starts, self.codes = from_planes(row["starts"]), from_planes(row["codes"])
        self.words = np.frombuffer(row["words"], np.int64)
        self.train = np.repeat(~self.held, np.diff(self.starts))
        self.first = np.zeros(len(self.codes), dtype=bool)
        self.first[self.starts[:-1]] = True
        self.slot, self.key, self.level = self.codes, self.words, 1
        self.sent = np.arange(len(self.words))  # every word is sent
        self.history = None
        self.count_own()

    def count_own(self) -> None:
        on = self.slot >= 0
        self.count = np.bincount(self.slot[on & self.train], minlength=len(self.key)).astype(np.int64)
        self.several = np.zeros(len(self.key), dtype=bool)

    def runs(self, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries to send, by range, and the range of each."""
        part = (mixed(self.key[self.sent], 77).view(np.uint64) % np.uint64(n_ranges)).astype(np.uint16 if n_ranges < 65536 else np.int64)
        order = np.argsort(part, kind="stable")
        return self.sent[order], part[order].astype(np.int64)

    def outgoing(self, n_ranges: int) -> pd.DataFrame:
        entries, part = self.runs(n_ranges)
        at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, dtype=int)
        own = [entries[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return pd.DataFrame({"range": part[at[:-1]] if len(part) else np.zeros(0, dtype=np.int64), "keys": [self.key[e].tobytes() for e in own], "counts": [planes(self.count[e]) for e in own]})

    def learn(self, back: pd.DataFrame, n_ranges: int) -> None:
        """Totals of the entries sent: one more than the count where several blocks have the entry, else 0."""
        entries, _ = self.runs(n_ranges)
        if len(entries):
            totals = np.concatenate([from_planes(b) for b in back.sort_values("range")["totals"]])  # as they were sent
            several = totals > 0
            self.several[entries[several]] = True
            self.count[entries[several]] = totals[several] - 1

    def climb(self, starts: int) -> None:
        """From level k to k+1. An arc begins in a state, an entry of level k that training has seen; at the first
        level beside it the start of a text. starts: number of training texts."""
        n = len(self.key)
        history = np.full(len(self.codes), n if self.level == 1 else -1, dtype=np.int64)  # n: the start of a text
        history[1:][~self.first[1:]] = self.slot[:-1][~self.first[1:]]
        count, key, several = np.append(self.count, starts), np.append(self.key, START_KEY), np.append(self.several, True)
        history[(history >= 0) & (count[history] == 0)] = -1
        on = np.flatnonzero(history >= 0)
        inverse, arcs = pd.factorize(history[on] * len(self.words) + self.codes[on])
        one = np.empty(len(arcs), dtype=np.int64)
        one[inverse] = on
        parent, lower = arcs // len(self.words), self.slot[one]  # lower: the arc's word after a history of one word less
        self.history, self.history_count = history, count
        shared = several[parent] & (lower >= 0) & self.several[lower] & (self.count[lower] > 0)
        self.key = mixed(key[parent], self.words[arcs % len(self.words)])
        self.slot = np.full(len(self.codes), -1, dtype=np.int64)
        self.slot[on] = inverse
        self.sent, self.level = np.flatnonzero(shared), self.level + 1
        self.count_own()


def at_level(row: pd.Series, back: pd.DataFrame, n_ranges: list[int], starts: int) -> Iterator[Block]:
    """The block at level 1, then 2, …, each with the totals in back; the level after those has its own counts only."""
    b = Block(row)
    for k, n in enumerate(n_ranges, 1):
        if k > 1:
            b.climb(starts)
        b.learn(back[back["level"] == k], n)
        yield b
    b.climb(starts)
    yield b


OUTGOING = "block long, range long, keys binary, counts binary"
TOTALS = "block long, level int, range long, totals binary"


def send_words(to: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                yield Block(row).outgoing(to).assign(block=row["block"])[["block", "range", "keys", "counts"]]

    return run


def send_arcs(n_ranges: list[int], to: int, starts: int):
    """A block's arcs of the level after those in n_ranges, by range."""

    def run(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["block", "range", "keys", "counts"])
        *_, b = at_level(own.iloc[0], back, n_ranges, starts)
        return b.outgoing(to).assign(block=own["block"].iloc[0])[["block", "range", "keys", "counts"]]

    return run


def add_up(level: int):
    """Totals of a range's hashes for each block that sent some, and how many hashes training has seen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["keys"]])
        counts = np.concatenate([from_planes(b) for b in pdf["counts"]])
        _, slot, often = np.unique(keys, return_inverse=True, return_counts=True)
        total = np.zeros(len(often), dtype=np.int64)
        np.add.at(total, slot, counts)
        back = np.where(often > 1, total + 1, 0)[slot]
        at = np.cumsum([0, *(len(b) // 8 for b in pdf["keys"])])
        seen = [int((total > 0).sum())] + [0] * (len(pdf) - 1)
        return pd.DataFrame({"block": pdf["block"], "level": level, "range": pdf["range"], "totals": [planes(back[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], "seen": seen})

    return run


def traverse(n_ranges: list[int], starts: int, n: int, v: int, mu: tuple[float, ...]):
    """The scores of a block's texts."""

    def run(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(own):
            return pd.DataFrame(columns=names)
        p = base = known = None
        for k, b in zip(range(len(n_ranges)), at_level(own.iloc[0], back, n_ranges, starts), strict=False):
            if k == 0:
                known = b.count[b.codes] > 0
                p = (b.count[b.codes] + 1.0) / (n + v + 1.0)
                base = np.log10(p)
                continue
            on = b.history >= 0  # elsewhere the history was never seen: the failure arcs lead below it
            seen, m = b.count[b.slot[on]], mu[min(k, len(mu)) - 1]
            p[on] = (seen + m * p[on]) / (b.history_count[b.history[on]] + m)
        return pd.DataFrame({"doc_id": b.ids, "held_out": b.held, "n_tokens": np.diff(b.starts), "n_known": sums(known.astype(np.int64), b.starts), "train_tokens": n, "base_score": sums(base, b.starts), "score": sums(np.log10(p), b.starts)})

    return run


def lm_score(docs: DataFrame, *, text="text", doc_id="doc_id", folds: int = 7, held_fold: int = 2, order: int = ORDER, mu: tuple[float, ...] = MU, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows whose crc32(doc_id as text) mod folds isn't held_fold, and scores all. Null text is empty: its one
    token is the end. A null id counts as the empty text and is scored as any row; repeated rows count as often as they
    occur. Without training rows N and V are 0, and every score is 0. A longer text than a block is a block of its own.
    An empty table gives an empty table. Other columns of docs are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    d = bounded_batches(docs).select(text_id(doc_id), (crc_mod(F.col(doc_id), folds) == held_fold).alias("held_out"), F.coalesce(text, F.lit("")).alias("t"))
    read = stage(d.mapInPandas(read_blocks(block), BLOCKS), "lm-blocks")
    sizes = read.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_words", "n_starts", "n_tokens")]).first()
    n, starts = sizes["n_train"], sizes["n_starts"]

    ranges = {1: max(sizes["n_words"] // group, 1)} | {k: max(sizes["n_tokens"] // group, 1) for k in range(2, order + 1)}
    back, n_ranges, v = None, [], 0
    for level, to in ranges.items():
        if back is None:
            sent = read.mapInPandas(send_words(to), OUTGOING)
        else:
            sent = read.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(send_arcs(list(n_ranges), to, starts), OUTGOING)
        totals = stage(sent.groupBy("range").applyInPandas(add_up(level), f"{TOTALS}, seen long"), f"lm-totals-{level}")
        if back is None:
            v = totals.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
        back = totals.drop("seen") if back is None else back.unionByName(totals.drop("seen"))
        n_ranges.append(to)
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = read.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(traverse(n_ranges, starts, n, v, mu), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
