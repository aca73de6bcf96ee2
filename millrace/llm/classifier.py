"""Quality classifier: a factorisation machine over hashed words, structure statistics and the stored length.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so all pairs of features count
in linear time. It is fitted on at most SAMPLE labelled rows (those with the smallest hash of their id) and then scores
every document where it is read. The fitted numbers, 2^15 hashed words and a dozen statistics with nine weights each,
take 1.2 MB at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, text_id
from .quality_rules import CLASS, DIGIT, LETTER_LEAD, OTHER, PUNCT, SPACE, SYMBOL, TAIL, UPPER, duplicate_lines, repeated_words
from .words import blocks, split_words

WORDS = 1 << 15
FACTORS = 8
SAMPLE = 8000
EPOCHS = 6
BLOCK = 2_000_000
STATISTICS = 14


def statistics(text: bytes, codes: np.ndarray, distinct: int, length: float) -> list[float]:
    c = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    chars = max(int(c.sum() - c[SPACE] - c[TAIL]), 1)
    n, lines = len(codes), text.count(b"\n") + 1
    repeat = repeated_words(codes, distinct)
    kinds = len(np.unique(codes))
    return [
        np.log1p(n), chars / max(n, 1), kinds / max(n, 1), c[SYMBOL] / chars, c[DIGIT] / chars, c[UPPER] / chars, c[PUNCT] / chars, c[OTHER] / chars, c[LETTER_LEAD] / chars,
        duplicate_lines(text) / lines, repeat / max(n, 1), np.log1p(n / lines), text.count(b"|") / max(n, 1), np.log1p(max(length, 0.0)),
    ]


def featured(pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each text: hashed words, their values (log counts, unit length), statistics."""
    import xxhash

    texts = [t.encode() for t in pdf["t"]]
    codes, starts, distinct = split_words(texts)
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) % WORDS for w in distinct), dtype=np.int32, count=len(distinct))
    length = pd.to_numeric(pdf["length"]).fillna(0).to_numpy(dtype=float)
    index, value, dense = [], [], np.zeros((len(texts), STATISTICS))
    for i, t in enumerate(texts):
        own = codes[starts[i] : starts[i + 1]]
        u, n = np.unique(bucket[own], return_counts=True)
        x = np.log1p(n).astype(np.float32)
        index.append(u.astype(np.int32))
        value.append(x / max(float(np.sqrt((x * x).sum())), 1e-9))
        dense[i] = statistics(t, own, len(distinct), length[i])
    return index, value, dense


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in blocks(batches, "t", BLOCK):
        index, value, dense = featured(pdf)
        yield pd.DataFrame({"label": pdf["label"], "h": pdf["h"], "i": [x.tobytes() for x in index], "x": [x.astype(np.float32).tobytes() for x in value], "d": [x.tobytes() for x in dense]})


class Machine:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(seed)
        self.b = 0.0
        self.w = np.zeros(WORDS + STATISTICS, dtype=np.float64)
        self.v = rng.normal(0, 0.01, (WORDS + STATISTICS, FACTORS))

    def rows(self, index, value, dense) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The statistics, standardised and held to 4 deviations, follow each text's words."""
        z = np.clip((dense - self.mean) / self.scale, -4, 4) / np.sqrt(STATISTICS)
        tail = np.arange(WORDS, WORDS + STATISTICS)
        i = np.concatenate([p for a in index for p in (a, tail)]).astype(np.int64)
        x = np.concatenate([p for a, b in zip(value, z, strict=True) for p in (a, b)]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(a) + STATISTICS for a in index])]).astype(np.int64)
        return i, x, starts

    def raw(self, i: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[i] * x[:, None]
        s = np.add.reduceat(vx, starts[:-1], axis=0)
        pairs = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts[:-1]))
        return self.b + np.add.reduceat(self.w[i] * x, starts[:-1]) + pairs, s, vx

    def score(self, index, value, dense) -> np.ndarray:
        if not len(index):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(index, value, dense))[0], -30, 30)))

    def fit(self, index, value, dense, y: np.ndarray, epochs: int, rate: float = 0.15, decay: float = 1e-5, batch: int = 128, seed: int = 11) -> None:
        """Logistic loss by Adagrad; each class weighs the same. y: 0 or 1."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
        gw, gv, gb = np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                i, x, starts = self.rows([index[r] for r in rows], [value[r] for r in rows], dense[rows])
                raw, s, vx = self.raw(i, x, starts)
                e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * weight[rows] / len(rows)
                of = np.repeat(np.arange(len(rows)), np.diff(starts))
                ui, inv = np.unique(i, return_inverse=True)
                dw = np.bincount(inv, weights=e[of] * x, minlength=len(ui)) + decay * self.w[ui]
                each = (e[of] * x)[:, None] * (s[of] - vx)
                dv = np.stack([np.bincount(inv, weights=each[:, f], minlength=len(ui)) for f in range(FACTORS)], axis=1) + decay * self.v[ui]
                gw[ui] += dw * dw
                gv[ui] += dv * dv
                gb += float(e.sum()) ** 2
                self.w[ui] -= rate * dw / np.sqrt(gw[ui])
                self.v[ui] -= rate * dv / np.sqrt(gv[ui])
                self.b -= rate * float(e.sum()) / np.sqrt(gb)


def fit_machine(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, length: str | None, label: str, label_id: str, folds: int, held_fold: int, sample: int, epochs: int) -> Machine | None:
    bounded_batches(docs)
    known = labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col(label_id), folds) != held_fold))
    known = known.groupBy(F.col(label_id).alias("lid")).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("lid")).orderBy("h", "lid").limit(sample)
    size = F.col(length).cast("double") if length in docs.columns else F.lit(0.0)
    own = docs.select(F.col(doc_id).alias("did"), F.coalesce(text, F.lit("")).alias("t"), size.alias("length"))
    some = own.join(F.broadcast(known), F.col("did") == F.col("lid"))  # at most `sample` ids
    # of rows that repeat an id the one with the smallest hash of its text, so that at most `sample` rows go to the driver
    some = some.groupBy("label", "h", "lid").agg(F.min(F.struct(F.xxhash64("t").alias("th"), "t", "length")).alias("one"))
    some = some.select("label", "h", F.col("one.t").alias("t"), F.col("one.length").alias("length"))
    rows = some.mapInPandas(features, "label int, h long, i binary, x binary, d binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["h", "i", "x"]).reset_index(drop=True)
    index = [np.frombuffer(b, np.int32) for b in rows["i"]]
    value = [np.frombuffer(b, np.float32) for b in rows["x"]]
    dense = np.stack([np.frombuffer(b, np.float64) for b in rows["d"]])
    machine = Machine(dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6))
    machine.fit(index, value, dense, rows["label"].to_numpy(dtype=float), epochs)
    return machine


def classify(docs: DataFrame, labels: DataFrame, *, text="text", doc_id="doc_id", length: str | None = "n_chars", label="quality", label_id="doc_id", folds: int = 3, held_fold: int = 1, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, held_out, score (that label 1 holds), predicted.

    Learns from labelled rows whose crc32(doc_id as text) mod folds isn't held_fold; an id with both labels counts as 1,
    and of rows that repeat a labelled id one text is learnt from.
    Null text is empty and is scored as an empty text; a null length counts as 0. Without usable labels every score is
    0.5. Repeated rows score alike. An empty table gives an empty table. Other columns of docs are left out.
    """
    machine = fit_machine(docs, labels, text=text, doc_id=doc_id, length=length, label=label, label_id=label_id, folds=folds, held_fold=held_fold, sample=sample, epochs=epochs)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "t", BLOCK):
            m = shared.value
            s = np.full(len(pdf), 0.5) if m is None else m.score(*featured(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    size = F.col(length).cast("double") if length in docs.columns else F.lit(0.0)
    d = bounded_batches(docs).select(text_id(doc_id), (crc_mod(F.col(doc_id), folds) == held_fold).alias("held_out"), F.coalesce(text, F.lit("")).alias("t"), size.alias("length"))
    out = d.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
