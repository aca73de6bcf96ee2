"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with its language's by Jensen-Shannon
distance (base 2: 0 alike, 1 apart). The references are counts over all documents of the language: classes summed, and
the COMMON most frequent words with the share of all others. PRIOR words of all languages together are added to each, so
that a language of a few texts doesn't stand for itself alone. A document is judged only from MIN_WORDS words on; it
diverges if a distance is above its limit, or if common words make up less than FEW of their share in the reference (the
distance of a text without any is bounded by that share, so it alone can't tell).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, stage, text_id
from .words import blocks, split_words

COMMON = 64
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.50
FEW = 0.25
PRIOR = 1000
#: References of all languages go to every task, a few KB each. ISO 639-3 names fewer languages than this; more distinct
#: values mean that the column holds something else, which is an error.
LANGUAGES = 8192
BLOCK = 2_000_000
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"

LOWER, UPPER, DIGIT, SPACE, PUNCT, SYMBOL, OTHER, LETTER_LEAD, TAIL = range(9)
#: Class of each byte of UTF-8; the first byte of a longer character counts for it, the others don't.
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[ord("a") : ord("z") + 1] = LOWER
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[32, *range(9, 14)]] = SPACE
CLASS[list(PUNCTUATION)] = PUNCT
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[0x80:0xC0] = TAIL
CLASS[0xC0:] = LETTER_LEAD
#: The histogram that is compared: every class that is a character and not white space.
COMPARED = [LOWER, UPPER, DIGIT, PUNCT, SYMBOL, OTHER, LETTER_LEAD]


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=9)


def plain(word: bytes) -> bytes:
    """A word as it is looked up among the common words."""
    return word.lower().strip(PUNCTUATION)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    sa, sb = a.sum(), b.sum()
    if not sa or not sb:
        return 0.0
    p, q = a / sa, b / sb
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    n = len(codes)
    if n < 4:
        return 0
    if distinct < 1 << 21:
        key = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:
        _, pair = np.unique(codes[:-2] * distinct + codes[1:-1], return_inverse=True)
        key = pair * distinct + codes[2:]
    ordered = np.sort(key)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    twice = pd.Series(key).duplicated(keep=False).to_numpy()
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) and, with an empty word, (lang, class, n) of each block."""
    for pdf in blocks(batches, "t", BLOCK):
        for lang, part in pdf.groupby("lang", dropna=False, sort=False):
            texts = [t.encode() for t in part["t"]]
            codes, _, distinct = split_words(texts)
            n = np.bincount(codes, minlength=len(distinct))
            classes = sum((class_counts(t) for t in texts), np.zeros(9, dtype=np.int64))
            words = np.array([plain(w).decode() for w in distinct], dtype=object)
            some = words != ""
            name = None if pd.isna(lang) else lang
            yield pd.DataFrame({"lang": pd.Series([name] * int(some.sum()), dtype=object), "word": pd.Series(words[some], dtype=object), "class": -1, "n": n[some]})
            yield pd.DataFrame({"lang": pd.Series([name] * len(COMPARED), dtype=object), "word": pd.Series([""] * len(COMPARED), dtype=object), "class": COMPARED, "n": classes[COMPARED]})


def references(docs: DataFrame, text: str, lang: str, common: int) -> tuple[DataFrame, dict, list[str]]:
    """(table of ref_lang and ref: a language's own counts as JSON; the same of all languages together; the table's refs,
    those with the most words first). A row of the table has `common` words of the language and those of them that
    are common in all."""
    d = bounded_batches(docs).select(F.col(lang).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("t"))
    n = d.mapInPandas(count_words, "lang string, word string, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    n = stage(n, "quality-counts")
    words, classes = n.where("class < 0"), n.where("class >= 0")
    pooled = stage(words.groupBy("word").agg(F.sum("n").alias("every")), "quality-pooled")
    first = pooled.orderBy(F.desc("every"), "word").limit(common).collect()
    sums = {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    total = pooled.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    pool = {"words": {r["word"]: r["every"] for r in first}, "total": total, "classes": [sums.get(c, 0) for c in COMPARED]}

    own = words.where("lang is not null")
    top = own.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= common)
    both = top.select("lang", "word", "n").unionByName(own.where(F.col("word").isin(list(pool["words"]))).select("lang", "word", "n")).distinct()
    lists = both.join(pooled, "word").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n", "every"))).alias("words"))  # 2 * common at most
    totals = own.groupBy("lang").agg(F.sum("n").alias("total"))
    by_class = classes.where("lang is not null").groupBy("lang").agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in COMPARED])
    table = totals.join(lists, "lang").join(by_class, "lang")
    table = table.select(F.col("lang").alias("ref_lang"), "total", F.to_json(F.struct("words", "total", F.array(*[f"c{c}" for c in COMPARED]).alias("classes"))).alias("ref"))
    table = stage(table, "quality-references")
    discard(n, pooled)
    every = [r["ref"] for r in table.orderBy(F.desc("total"), "ref_lang").limit(LANGUAGES + 1).collect()]
    if len(every) > LANGUAGES:
        raise ValueError(f"{lang} holds more than {LANGUAGES} values")
    return table.drop("total"), pool, every


class Reference:
    """A language's histograms: its own counts and `prior` words of all languages together."""

    def __init__(self, own: dict | None, pool: dict, common: int, prior: float):
        total, letters = max(pool["total"], 1), max(sum(pool["classes"]), 1)
        value = {w: prior * n / total for w, n in pool["words"].items()}
        for x in own["words"] if own else ():
            value[x["word"]] = x["n"] + prior * x["every"] / total
        if own is None:
            value = dict(pool["words"])
        best = sorted(value, key=lambda w: (-value[w], w))[:common]
        self.place = {w.encode(): k for k, w in enumerate(best)}
        rest = (own["total"] + prior if own else total) - sum(value[w] for w in best)
        self.words = np.array([*(value[w] for w in best), max(rest, 0)], dtype=float)
        every = np.array(pool["classes"], dtype=float)
        self.classes = np.array(own["classes"], dtype=float) + prior * every.sum() / total * every / letters if own else every
        self.share = 1 - self.words[-1] / max(self.words.sum(), 1)

    def apart(self, words: np.ndarray, classes: np.ndarray, looked: np.ndarray) -> tuple[float, float, float]:
        """A text's distances, and its share of common words beside the reference's."""
        common = np.bincount(looked[words], minlength=len(self.words))
        share = 1 - common[-1] / max(len(words), 1)
        return distance(classes[COMPARED], self.classes), distance(common, self.words), share / self.share if self.share else 1.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """distance() of one histogram and each row of b."""
    sa, sb = a.sum(axis=-1, keepdims=True), b.sum(axis=1, keepdims=True)
    p, q = a / np.maximum(sa, 1), b / np.where(sb > 0, sb, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where((sa > 0).ravel() & (sb > 0).ravel(), np.sqrt(np.maximum(d / 2, 0)), 0.0)


class AllReferences:
    """All languages' histograms as matrices, so that a text is held against all of them at once; the last row is that of
    all languages together."""

    def __init__(self, refs: list[Reference]):
        words = sorted({w for r in refs for w in r.place})
        self.place = {w: k for k, w in enumerate(words)}
        #: By reference and place among its common words the word's number; len(words) where it has fewer.
        self.which = np.full((len(refs), max(len(r.words) for r in refs) - 1), len(words))
        self.words = np.zeros((len(refs), self.which.shape[1] + 1))
        for k, r in enumerate(refs):
            self.which[k, : len(r.place)] = [self.place[w] for w in r.place]
            self.words[k, : len(r.place)], self.words[k, -1] = r.words[:-1], r.words[-1]
        self.classes, self.share = np.stack([r.classes for r in refs]), np.array([r.share for r in refs])
        self.counts = np.zeros(len(words) + 1)

    def apart(self, looked: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Reference.apart, for each reference. looked: the text's words by number, len(self.place) for all others."""
        kinds, n = np.unique(looked, return_counts=True)
        self.counts[kinds] = n
        self.counts[-1] = 0
        common = self.counts[self.which]
        self.counts[kinds] = 0
        known = common.sum(axis=1, keepdims=True)
        common = np.concatenate([common, len(looked) - known], axis=1)
        share = known.ravel() / max(len(looked), 1)
        return distances(classes[COMPARED].astype(float)[None], self.classes), distances(common, self.words), np.where(self.share > 0, share / np.where(self.share > 0, self.share, 1), 1.0)


def judge(pool: dict, every: list[str], common: int, prior: float, max_char: float, max_word: float, few: float, min_words: int, block: int):
    """Verdicts on rows with t and ref (null: held against all languages together)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, Reference] = {}
        others: AllReferences | None = None

        def reference(ref: str | None) -> Reference:
            if ref not in known:
                known[ref] = Reference(json.loads(ref) if ref else None, pool, common, prior)
            return known[ref]

        for pdf in blocks(batches, "t", block):
            texts = [t.encode() for t in pdf["t"]]
            codes, starts, distinct = split_words(texts)
            words = [plain(w) for w in distinct]
            looked: dict[str | None, np.ndarray] = {}
            among_all = None
            rows = []
            for i, (t, own_ref) in enumerate(zip(texts, pdf["ref"], strict=True)):
                own = codes[starts[i] : starts[i + 1]]
                classes = class_counts(t)
                n, repeat = len(own), repeated_words(own, len(distinct))
                failed = n < 50 or 100 * repeat > 50 * n
                own_ref = own_ref if isinstance(own_ref, str) else None
                r = reference(own_ref)
                if own_ref not in looked:
                    looked[own_ref] = np.array([r.place.get(w, len(r.place)) for w in words], dtype=np.int64)
                char_d, word_d, share = r.apart(own, classes, looked[own_ref])
                diverges = n >= min_words and (char_d > max_char or word_d > max_word or share < few)
                if diverges and not failed:  # the others: its label may be wrong, or it may mix languages
                    if others is None:
                        others = AllReferences([reference(x) for x in (*every, None)])
                    if among_all is None:
                        among_all = np.array([others.place.get(w, len(others.place)) for w in words], dtype=np.int64)
                    char_all, word_all, share_all = others.apart(among_all[own], classes)
                    takes = np.flatnonzero((char_all <= max_char) & (word_all <= max_word) & (share_all >= few))
                    if len(takes):
                        diverges, char_d, word_d = False, float(char_all[takes[0]]), float(word_all[takes[0]])
                rows.append((n, int(classes.sum() - classes[SPACE] - classes[TAIL]), int(classes[SYMBOL]), duplicate_lines(t), repeat, failed, not failed and not diverges, char_d, word_d))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
            yield pdf.drop(columns=["t", "ref"]).join(pd.DataFrame(rows, columns=names, index=pdf.index))

    return run


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def with_references(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (with a column own_lang) and each one's reference; the table has a row a language, LANGUAGES at most."""
    return rows.join(F.broadcast(table), F.col("own_lang") == F.col("ref_lang"), "left").drop("own_lang", "ref_lang")


def quality_rules(
    docs: DataFrame, *, text="text", doc_id="doc_id", lang="lang", common: int = COMMON, prior: float = PRIOR,
    max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, few: float = FEW, min_words: int = MIN_WORDS, block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, and both distances (to the reference that took it, else
    to its own).

    A text that its own language's reference rejects stays if that of any other language takes it, or that of all together:
    labels may be wrong and texts may mix languages, junk is far from all of them. More than LANGUAGES languages are an error.

    Null text has no words and fails. A null language is held against all languages together. Repeated rows count as
    often as they occur. An empty table gives an empty table. Other columns of docs are left out.
    """
    table, pool, every = references(docs, text, lang, common)
    d = docs.select(text_id(doc_id), F.col(lang).cast("string").alias("own_lang"), F.coalesce(text, F.lit("")).alias("t"))
    judged = judge(pool, every, common, prior, max_char, max_word, few, min_words, block)
    out = with_references(d, table).mapInPandas(judged, f"doc_id string, {MEASURES}")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def passing(
    docs: DataFrame, *, text="text", lang="lang", common: int = COMMON, prior: float = PRIOR,
    max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, few: float = FEW, min_words: int = MIN_WORDS, block: int = BLOCK,
) -> DataFrame:
    """The documents that the rules keep, in the columns of docs and with their values as they are (rows go through Python
    as Arrow batches, of which only text and reference are looked at). Nulls, empty tables and repeats as in quality_rules."""
    table, pool, every = references(docs, text, lang, common)
    judged = judge(pool, every, common, prior, max_char, max_word, few, min_words, block)

    def keep(batches):
        for b in batches:
            rows = b.column("row")
            work = pd.DataFrame({"at": np.arange(b.num_rows), "t": rows.field(text).to_pandas(), "ref": b.column("ref").to_pandas()})
            for part in judged(iter([work])):
                stays = rows.take(pa.array(part["at"][part["kept"]].to_numpy()))
                yield pa.RecordBatch.from_arrays(stays.flatten(), names=names)

    names = docs.columns
    d = docs.select(F.struct("*").alias("row"), F.col(lang).cast("string").alias("own_lang"))
    return with_references(d, table).mapInArrow(keep, docs.schema)
