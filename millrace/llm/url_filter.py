"""URL filters: host rules, and a character language-model ratio for what no rule fits.

Two variable-order Markov models are trained on all URLs that a rule accepts or rejects. A character's probability is
that after its longest context (up to three characters) seen MIN_CONTEXT times, blended with the shorter ones by
Witten-Bell weights. A URL's score is the mean over its characters of log P_accepted - log P_rejected. The threshold is
the one that parts accepted from rejected URLs best among the fifth of them that trained no model.

The alphabet has 40 signs, so the counts are at most 2 * 40^4 numbers and the table of ratios is 10 MB at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

ALPHABET = 40
ORDER = 3
MIN_CONTEXT = 4
BINS = 400
SPAN = 4.0
#: Fixed rules of the query: (host and path, verdict). A rule without "/" would fit any path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: 26 letters, 10 digits, "/", ".", "-", all else.
SIGN = np.full(256, 39, dtype=np.int64)
SIGN[ord("a") : ord("z") + 1] = np.arange(26)
SIGN[ord("A") : ord("Z") + 1] = np.arange(26)
SIGN[ord("0") : ord("9") + 1] = np.arange(26, 36)
SIGN[[ord("/"), ord("."), ord("-")]] = [36, 37, 38]


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest last, so it is asked first
        h, slash, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each character with its context as one number, and where each URL begins. The scheme is left out."""
    pad = b"/" * ORDER
    texts = [pad + (u or "").partition("://")[2].encode() if "://" in (u or "") else pad + (u or "").encode() for u in urls]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    signs = SIGN[np.frombuffer(b"".join(texts), np.uint8)]
    cell = signs.copy()
    for k in range(1, ORDER + 1):
        cell[ORDER:] += signs[ORDER - k : len(signs) - k] * ALPHABET**k
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    real = np.ones(len(signs), dtype=bool)
    for k in range(ORDER):
        real[begin + k] = False
    return cell[real], np.concatenate([[0], np.cumsum(size - ORDER)]).astype(np.int64)


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for accepted, part in pdf.groupby("accepted"):
            cells, n = np.unique(grams(list(part["url"]))[0], return_counts=True)
            yield pd.DataFrame({"accepted": bool(accepted), "cell": cells, "n": n})


def log_probability(counts: np.ndarray) -> np.ndarray:
    """counts: [context..., sign] for the longest context; log P for every context of that length."""
    p = np.full(ALPHABET, 1 / ALPHABET)
    for order in range(ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - order))).astype(float)  # [order signs of context, sign]
        seen, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        blended = (c + kinds * p) / np.maximum(seen + kinds, 1)
        p = np.where(seen >= MIN_CONTEXT, blended, np.broadcast_to(p, c.shape))
    return np.log(p)


def scores(urls: list[str | None], ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio per character; 0 for a URL without any."""
    cell, starts = grams(urls)
    run = np.concatenate([[0.0], np.cumsum(ratio[cell].astype(np.float64))])
    return (run[starts[1:]] - run[starts[:-1]]) / np.maximum(np.diff(starts), 1)


def threshold(hist: dict[tuple[bool, int], int]) -> float:
    """The bin edge with most of the accepted above plus most of the rejected below, the middle one of equals."""
    good, bad = (np.array([hist.get((side, b), 0) for b in range(BINS)], dtype=float) for side in (True, False))
    if not good.sum() or not bad.sum():
        return 0.0
    edges = np.linspace(-SPAN, SPAN, BINS + 1)
    above = np.concatenate([np.cumsum(good[::-1])[::-1], [0]]) / good.sum()
    below = np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    total = np.round(above + below, 9)
    best = np.flatnonzero(total == total.max())
    return float(edges[best[len(best) // 2]])


def url_filter(pages: DataFrame, *, url="url", page_id="page_id", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A null URL, or one without "://", has empty host and path, fits no rule and is judged by its characters; an empty
    one scores 0. Without accepted or rejected URLs to learn from every score is 0 and the verdict "allow". Repeated rows
    count as often as they occur. An empty table gives an empty table. Other columns of pages are left out.
    """
    spark = pages.sparkSession
    d = bounded_batches(pages).select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    d = d.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "said": verdict})
    labelled = d.where("rule is not null").select((F.col("said") == "allow").alias("accepted"), "url", (F.crc32("url") % 5 == 0).alias("calibrates"))
    found = labelled.where("not calibrates").mapInPandas(count_grams, "accepted boolean, cell long, n long").groupBy("accepted", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, ALPHABET ** (ORDER + 1)), dtype=np.int64)
    counts[found["accepted"].to_numpy(dtype=int), found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    if counts.sum(axis=1).all():
        accepted, rejected = (log_probability(c.reshape((ALPHABET,) * (ORDER + 1))) for c in counts[::-1])
        ratio = (accepted - rejected).astype(np.float32).ravel()
    else:
        ratio = np.zeros(ALPHABET ** (ORDER + 1), dtype=np.float32)
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(u: pd.Series) -> pd.Series:
        return pd.Series(scores([None if pd.isna(x) else x for x in u], shared.value), dtype=float)

    place = F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN)))
    hist = labelled.where("calibrates").withColumn("score", score("url")).groupBy("accepted", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin")).count().collect()
    limit = threshold({(r["accepted"], r["bin"]): r["count"] for r in hist})
    d = d.withColumn("score", score("url"))
    verdict = F.coalesce("said", F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block")))
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
