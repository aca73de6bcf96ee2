"""Language ID by a linear-chain conditional random field over words.

A word's features are its character n-grams, its affixes (n-grams that touch a mark before or behind the word), the word
itself, and how common it is in each language's lexicon. Their weights and those of transitions from language to
language are learned together. Every word of every text then gets its probability of each language by forward-backward,
so that a text may change its language on the way; the text's language is the one with the largest expected share.

The lexicon comes from counts over all texts that may be learned from: words with at least SHARE of their language's
words, which are 1 / SHARE at most. Weights are fitted on a bounded sample: per language SAMPLE / languages texts with
the smallest hashes, a run of RUN words from a random place of each. Texts have one label each, so runs are cut into
pieces which are strung together at random: sequences in which languages change, from which transitions can be learned.

Forward-backward runs over all texts of a batch at once. Texts are cut into segments; the product of a segment's
matrices says how it carries any state on, so that the states at all segments' ends take one short pass over segments,
and all words' probabilities a pass in which every segment is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_mod

C = F.col
SHARE = 1e-4
SAMPLE = 4000
RUN = 128
EPOCHS = 5
#: Hashed n-grams, and as many hashed words behind them.
HASHED = 1 << 16
#: Lengths of n-grams in UTF-8 bytes, marks included.
GRAMS = (2, 3, 4, 5)
#: Words of a segment, and of a training sequence.
SEGMENT = 64
#: Bytes of texts whose words are counted, or labelled, together.
COUNT_BLOCK = 8_000_000
LABEL_BLOCK = 2_000_000
UNKNOWN = "und"
#: Scores below the best one by more than this count as this.
LEAST = 30.0

#: All ASCII but a-z to blanks, after lower-casing; UTF-8 writes all other characters in bytes from 0x80 on.
FOLD = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII characters that are no letters, lower-cased. Some may hold no letter at all."""
    return text.decode("utf-8", "replace").lower().encode().translate(FOLD).split()


def has_letter(word: bytes) -> bool:
    return word.isascii() or any(c.isalpha() for c in word.decode())


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes, starts, distinct) of all texts' words that hold a letter; starts has one more entry at the end."""
    every: list[bytes] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        every += words(t)
        starts[i + 1] = len(every)
    boxed = np.empty(len(every), dtype=object)
    boxed[:] = every
    codes, distinct = pd.factorize(boxed)
    good = np.fromiter(map(has_letter, distinct), dtype=bool, count=len(distinct))
    if not good.all():
        own = good[codes]
        starts = np.concatenate([[0], np.cumsum(own)])[starts]
        codes = (np.cumsum(good) - 1)[codes[own]]
        distinct = distinct[good]
    return codes.astype(np.int64), starts, list(distinct)


def features(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, starts): each word's hashed n-grams and affixes and the word itself, one after another."""
    marked = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in distinct), dtype=np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) + 2
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(marked))
    of = np.repeat(np.arange(len(distinct)), length)
    index, word = [HASHED + np.fromiter(map(crc32, distinct), dtype=np.int64, count=len(distinct)) % HASHED], [np.arange(len(distinct))]
    h = np.zeros(len(marked), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(marked) - n + 1] * np.uint64(257) + marked[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = left[: len(h)] >= n
            index.append((((h[inside] + np.uint64(n)) * ODD) >> np.uint64(48)).astype(np.int64) % HASHED)
            word.append(of[: len(h)][inside])
    word = np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return np.concatenate(index)[order], np.searchsorted(word[order], np.arange(len(distinct)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows that add up to 1."""
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Segments:
    """Pieces of texts, longest first. first: a text begins here; text, place: which text's, which of its segments."""

    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, step: int = SEGMENT) -> Segments:
        n = np.diff(starts)
        count = -(-n // step)
        text = np.repeat(np.arange(len(n)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n[text] - place * step, step)
        order = np.argsort(-length, kind="stable")
        return cls((starts[text] + place * step)[order], length[order], text[order], place[order])

    @property
    def first(self) -> np.ndarray:
        return self.place == 0

    def longer(self) -> list[int]:
        """For each step, how many segments are long enough to take it."""
        return np.searchsorted(-self.length, -np.arange(int(self.length.max(initial=0))), side="left").tolist()


class Field:
    """The weights: n-grams and words by language, lexicon by language, transitions and beginnings."""

    def __init__(self, languages: list[str], lexicon: dict[bytes, np.ndarray]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weight = np.zeros((2 * HASHED, k))
        self.common = np.zeros((k, k))
        self.change = np.zeros((k, k))
        self.begin = np.zeros(k)

    def in_lexicon(self, distinct: list[bytes]) -> np.ndarray:
        none = np.zeros(len(self.languages))
        return np.array([self.lexicon.get(w, none) for w in distinct]).reshape(-1, len(self.languages))

    def scores(self, index: np.ndarray, starts: np.ndarray, common: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weight[index], starts, axis=0) + common @ self.common

    def emissions(self, scores: np.ndarray) -> np.ndarray:
        return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -LEAST))

    def potentials(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(self.change - self.change.max()), np.exp(self.begin - self.begin.max())

    def ends(self, s: Segments, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before each segment, and how well each state at its end goes on with what follows."""
        change, begin = self.potentials()
        k = len(begin)
        product = np.broadcast_to(np.eye(k), (len(s.start), k, k)).copy()
        for t, m in enumerate(s.longer()):
            now = (product[:m].reshape(-1, k) @ change).reshape(m, k, k)
            if t == 0:
                now[s.first[:m]] = product[:m][s.first[:m]]
            now *= e[s.start[:m] + t][:, None, :]
            product[:m] = now / now.max(axis=(1, 2), keepdims=True)
        before, after = np.empty((len(s.start), k)), np.ones((len(s.start), k))
        before[s.first] = unit(begin)
        by_place = np.split(np.lexsort((s.text, s.place)), np.cumsum(np.bincount(s.place))[:-1])
        follow = [(here[np.isin(s.text[here], s.text[there], assume_unique=True)], there) for here, there in pairwise(by_place)]
        for here, there in follow:
            before[there] = unit(np.einsum("di,dij->dj", before[here], product[here]))
        for here, there in reversed(follow):
            after[here] = unit(np.einsum("dij,dj->di", product[there], after[there]))
        return before, after

    def within(self, s: Segments, e: np.ndarray, before: np.ndarray, after: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Each word's probability of each language. pairs: gets the expected numbers of transitions within segments."""
        change, _ = self.potentials()
        forward, out, longer = np.empty_like(e), np.empty_like(e), s.longer()
        state = before.copy()
        for t, m in enumerate(longer):
            now = state[:m] @ change
            if t == 0:
                now[s.first[:m]] = state[:m][s.first[:m]]
            state[:m] = unit(now * e[s.start[:m] + t])
            forward[s.start[:m] + t] = state[:m]
        rest = after.copy()
        for t in range(len(longer) - 1, -1, -1):
            m = longer[t]
            at = s.start[:m] + t
            out[at] = unit(forward[at] * rest[:m])
            onward = e[at] * rest[:m]
            if pairs is not None and t:
                was = forward[at - 1]
                pairs += change * (was.T @ (onward / ((was @ change) * onward).sum(axis=1, keepdims=True)))
            rest[:m] = unit(onward @ change.T)
        return out

    def probabilities(self, codes: np.ndarray, starts: np.ndarray, distinct: list[bytes]) -> np.ndarray:
        if not len(codes):
            return np.zeros((0, len(self.languages)))
        e = self.emissions(self.scores(*features(distinct), self.in_lexicon(distinct)))[codes]
        s = Segments.of(starts)
        return self.within(s, e, *self.ends(s, e))

    def fit(self, codes: np.ndarray, labels: np.ndarray, distinct: list[bytes], epochs: int, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 3) -> None:
        """Conditional likelihood by Adagrad over sequences of SEGMENT words."""
        index, starts = features(distinct)
        ends = np.append(starts[1:], len(index))
        common = self.in_lexicon(distinct)
        bounds = np.append(np.arange(0, len(codes), SEGMENT), len(codes))
        rng, k = np.random.default_rng(seed), len(self.languages)
        size = [np.full(p.shape, 1e-2) for p in (self.weight, self.common, self.change, self.begin)]
        for _ in range(epochs):
            order = rng.permutation(len(bounds) - 1)
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                where = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in own])
                local = Segments.of(np.concatenate([[0], np.cumsum(bounds[own + 1] - bounds[own])]))
                kinds, word = np.unique(codes[where], return_inverse=True)
                count = ends[kinds] - starts[kinds]
                first = np.cumsum(count) - count
                which = np.repeat(starts[kinds] - first, count) + np.arange(count.sum())
                e = self.emissions(self.scores(index[which], first, common[kinds]))[word]
                _, begin = self.potentials()
                pairs = np.zeros((k, k))
                p = self.within(local, e, np.broadcast_to(unit(begin), (len(local.start), k)), np.ones((len(local.start), k)), pairs)
                y = labels[where]
                error = -p
                error[np.arange(len(y)), y] += 1
                inner = np.ones(len(y), dtype=bool)
                inner[local.start] = False
                seen = np.zeros((k, k))
                np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
                by_word = np.stack([np.bincount(word, weights=error[:, c], minlength=len(kinds)) for c in range(k)], axis=1) / len(own)
                grad = np.stack([np.bincount(index[which], weights=np.repeat(by_word[:, c], count), minlength=2 * HASHED) for c in range(k)], axis=1)
                steps = [
                    (self.weight, size[0], grad - decay * self.weight),
                    (self.common, size[1], common[kinds].T @ by_word - decay * self.common),
                    (self.change, size[2], (seen - pairs) / len(own) - decay * self.change),
                    (self.begin, size[3], error[local.start].sum(axis=0) / len(own) - decay * self.begin),
                ]
                for weight, total, g in steps:
                    total += g * g
                    weight += rate * g / np.sqrt(total)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), some words several times."""

    def counted(texts: list[bytes], langs: list[str]) -> pa.RecordBatch:
        codes, starts, distinct = coded(texts)
        kinds, own = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
        pair, n = np.unique(np.repeat(own.astype(np.int64), np.diff(starts)) * max(len(distinct), 1) + codes, return_counts=True)
        lang, word = np.divmod(pair, max(len(distinct), 1))
        return pa.RecordBatch.from_arrays([pa.array(kinds[lang].tolist(), pa.string()), pa.array([distinct[w] for w in word.tolist()], pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    texts, langs, held = [], [], 0
    for batch in batches:
        for t, lang in zip(batch.column("t").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            texts.append(t)
            langs.append(lang)
            held += len(t)
            if held >= COUNT_BLOCK:
                yield counted(texts, langs)
                texts, langs, held = [], [], 0
    if texts:
        yield counted(texts, langs)


def lexicon(train: DataFrame, languages: list[str], share: float) -> dict[bytes, np.ndarray]:
    """For each word that is common in a language 1 + log10(its share / `share`), 0 where it isn't."""
    counts = train.select("t", "lang").mapInArrow(word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    common = counts.join(F.broadcast(totals), "lang").where(C("n") >= share * C("all"))  # a row a language
    rows = common.select("lang", "word", (C("n") / C("all")).alias("share")).collect()  # at most 1 / share a language
    place, out = {lang: i for i, lang in enumerate(languages)}, {}
    for r in rows:
        out.setdefault(bytes(r.word), np.zeros(len(languages)))[place[r.lang]] = 1 + np.log10(r.share / share)
    return out


def runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """A run of words from a place that the row's hash names, of each text with letters."""
    for batch in batches:
        rows = []
        for t, lang, h in zip(*(batch.column(c).to_pylist() for c in ("t", "lang", "h")), strict=True):
            own = [w for w in words(t) if has_letter(w)]
            if own:
                at = h % max(len(own) - run + 1, 1)
                rows.append((lang, h, b" ".join(own[at : at + run])))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "h", "words"])


def spliced(rows: list[tuple[int, list[bytes]]], seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes, labels, distinct) of all runs, cut into pieces of 8 to 40 words that follow each other at random."""
    rng = np.random.default_rng(seed)
    pieces = []
    for label, own in rows:
        at = 0
        while at < len(own):
            n = int(rng.integers(8, 41))
            pieces.append((label, own[at : at + n]))
            at += n
    order = rng.permutation(len(pieces))
    every = np.array([w for i in order for w in pieces[i][1]], dtype=object)
    codes, distinct = pd.factorize(every)
    labels = np.repeat([pieces[i][0] for i in order], [len(pieces[i][1]) for i in order])
    return codes.astype(np.int64), labels.astype(np.int64), list(distinct)


def fit_field(docs: DataFrame, *, text="text", doc_id="doc_id", lang="lang", folds: int = 3, held_fold: int = 1, share: float = SHARE, sample: int = SAMPLE, run: int = RUN, epochs: int = EPOCHS) -> Field | None:
    """The field learned from rows with text and lang whose crc32(doc_id as text) mod folds isn't held_fold; None without any."""
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    train = bounded_batches(docs).where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (crc_mod(F.col(doc_id), folds) != held_fold))
    train = train.select(F.col(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("lang"), F.shiftrightunsigned(key, 1).alias("h"))
    # rows that repeat id and text have one hash; languages without a text keep their place
    hashes = {r.lang: r.n for r in train.groupBy("lang").agg(F.approx_count_distinct(F.when(F.length("t") > 0, C("h"))).alias("n")).collect()}
    languages = sorted(hashes)
    if not languages:
        return None
    common = lexicon(train, languages, share)
    most = max(sample // len(languages), 1)
    # of each language about twice as many hashes as are needed, then the smallest of these
    bound = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(int(2 * most / max(hashes[lang], 1) * 2**63), 2**63 - 1))])
    some = train.where((F.length("t") > 0) & (C("h") <= bound[C("lang")])).groupBy("lang", "h").agg(F.min("t").alias("t"))
    some = some.mapInArrow(lambda b: runs(b, run), "lang string, h long, words binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = some.withColumn("place", place).where(C("place") <= most).collect()  # at most `sample` runs of words
    field = Field(languages, common)
    if rows:
        label = {x: i for i, x in enumerate(languages)}
        codes, labels, distinct = spliced([(label[r.lang], bytes(r.words).split()) for r in sorted(rows, key=lambda r: (r.lang, r.h, bytes(r.words)))])
        field.fit(codes, labels, distinct, epochs)
    return field


def labelled(texts: list[bytes], field: Field) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Of each text its words' probabilities, and the words."""
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= LABEL_BLOCK):
            held += len(texts[upto])
            upto += 1
        codes, starts, distinct = coded(texts[at:upto])
        p = field.probabilities(codes, starts, distinct)
        for a, b in pairwise(starts.tolist()):
            yield p[a:b], [distinct[c] for c in codes[a:b]] if b > a else []
        at = upto


def identify(docs: DataFrame, *, text="text", doc_id="doc_id", lang="lang", folds: int = 3, held_fold: int = 1, share: float = SHARE, sample: int = SAMPLE, run: int = RUN, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches of each row.

    score is the expected share of the text's words that are in lang_pred; n_switches counts neighbouring words whose
    likeliest languages differ. Texts that are null or have no letter are `und` with score 0, as are all if there is
    nothing to learn from. Of equal shares the first language by name counts. Null languages aren't learned from; a null
    id counts as the empty text; rows that repeat score alike, and of those that repeat id and text one is learned from.
    Texts of any length are read whole. An empty table gives an empty one. Other columns are left out.
    """
    field = fit_field(docs, text=text, doc_id=doc_id, lang=lang, folds=folds, held_fold=held_fold, share=share, sample=sample, run=run, epochs=epochs)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            langs, scores, n_words, switches = [], [], [], []
            texts = [t or b"" for t in batch.column("t").to_pylist()]
            for p, own in labelled(texts, f) if f is not None else (([], []) for _ in texts):
                mean = p.mean(axis=0) if len(own) else None
                langs.append(UNKNOWN if mean is None else f.languages[int(mean.argmax())])
                scores.append(0.0 if mean is None else float(min(mean.max(), 1.0)))
                n_words.append(len(own))
                switches.append(int((np.diff(p.argmax(axis=1)) != 0).sum()) if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(n_words, pa.int64()), pa.array(switches, pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"],
            )

    d = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), (crc_mod(F.col(doc_id), folds) == held_fold).alias("held_out"), F.col(text).cast("binary").alias("t"))
    kinds = [d.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType())]
    return d.mapInArrow(predict, T.StructType(kinds))


def label_words(docs: DataFrame, field: Field, *, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, words: each word (lower-cased) with its likeliest language and that one's probability, in the text's order."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            rows = [
                [{"word": w.decode(), "lang": f.languages[k], "probability": float(x[k])} for w, x, k in zip(own, p, p.argmax(axis=1).tolist() if len(own) else [], strict=True)]
                for p, own in labelled([t or b"" for t in batch.column("t").to_pylist()], f)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "words"])

    d = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], T.StructField("words", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType())])))]))
