"""Token counts by dynamic programming over a trie.

A unigram segmentation of a pre-token maximises the sum of its pieces' log probabilities. The best score of a prefix
depends on the prefix only, so the distinct pre-tokens of a task go into a trie, each node gets its score and number of
pieces once, from its ancestors, when it is made, and the node where a pre-token ends holds its count. Texts are
counted where they are read; nothing is shuffled.

A node holds a score and a count, so a trie has a limit of nodes, after which it starts anew. A pre-token of over LONG
characters would fill one by itself and shares hardly anything: its scores are computed without nodes, holding only those
of as many characters back as the longest piece has. Both ways give the same counts.

Pieces come from a public vocabulary file and weigh as in Zipf's law by their rank there. Characters that no piece
covers count as their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_id
from .words import blocks, split_words, sums

SPACE_MARK = "▁"
BLOCK = 4_000_000
NODES = 1_500_000
LONG = 1000


def piece_weights(path: str) -> dict[str, float]:
    """log probability of each ordinary piece, by rank, Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ids.sort(key=lambda i: -model.get_score(i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ids)}


class Trie:
    """Prefixes with their best score and its number of pieces. Of equal scores the one with fewer pieces counts."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        #: Every end of a piece; with its weight where it is a piece itself. Longer ends are asked only if shorter ones exist.
        self.ends: dict[str, float | None] = {}
        for p in pieces:
            for k in range(len(p)):
                self.ends.setdefault(p[k:], None)
        self.ends.update(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=-10.0) - 1
        self.limit = nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.pieces = [0.0], [0]

    def count(self, token: str) -> int:
        """Pieces of the best segmentation of a pre-token."""
        if len(token) > LONG:
            return self.count_long(token)
        if len(self.score) > self.limit:
            self.clear()
        child, score, pieces, ends = self.child, self.score, self.pieces, self.ends
        path, node = [0], 0
        for d, ch in enumerate(token, 1):
            step = (node, ch)
            node = child.get(step, -1)
            if node < 0:
                n = len(ch.encode())
                up = path[d - 1]
                best, least = score[up] + n * self.byte, pieces[up] + n
                at = d - 1
                while at >= 0:
                    end = token[at:d]
                    if end not in ends:
                        break
                    w = ends[end]
                    if w is not None:
                        s, c = score[path[at]] + w, pieces[path[at]] + 1
                        if s > best or (s == best and c < least):
                            best, least = s, c
                    at -= 1
                node = child[step] = len(score)
                score.append(best)
                pieces.append(least)
            path.append(node)
        return pieces[node]

    def count_long(self, token: str) -> int:
        """The same without nodes: a ring of the last scores."""
        ring, ends = self.longest + 1, self.ends
        score, pieces = [0.0] * ring, [0] * ring
        for d, ch in enumerate(token, 1):
            n, up = len(ch.encode()), (d - 1) % ring
            best, least = score[up] + n * self.byte, pieces[up] + n
            for at in range(d - 1, max(d - ring, -1), -1):
                end = token[at:d]
                if end not in ends:
                    break
                w = ends[end]
                if w is not None:
                    s, c = score[at % ring] + w, pieces[at % ring] + 1
                    if s > best or (s == best and c < least):
                        best, least = s, c
            score[d % ring], pieces[d % ring] = best, least
        return pieces[len(token) % ring]


def counter(path: str, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(piece_weights(path))
        for pdf in blocks(batches, "t", block):
            codes, starts, distinct = split_words([t.encode() for t in pdf["t"]])
            each = np.fromiter((trie.count(SPACE_MARK + w.decode()) for w in distinct), dtype=np.int64, count=len(distinct))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": np.diff(starts), "n_tokens": sums(each[codes], starts)})

    return run


def token_counts(docs: DataFrame, *, vocabulary: str, text="text", doc_id="doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (of the best segmentation of each word with a space mark before it).

    Null and empty texts have none. Repeated rows are counted each. An empty table gives an empty table. Other columns
    of docs are left out.
    """
    d = bounded_batches(docs).select(text_id(doc_id), F.coalesce(text, F.lit("")).alias("t"))
    out = d.mapInPandas(counter(vocabulary, block), "doc_id string, n_words long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
