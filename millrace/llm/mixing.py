"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u)/w: u from a hash of its id, w its quality weight. A source's target is
met by whole epochs first; the rest is a sample without replacement, taken in key order up to the token budget.

No source is ever sorted as a whole. Keys fall into BUCKETS ranges; sizes are summed per (source, range), and the
running sums over those ranges name the one range in which the budget ends. Only that range's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage, word_count

BUCKETS = 4096
#: A table of targets has one row per source; beyond so many it is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000
P = "__mix_"


def quality_weight(text: Column, n: Column) -> Column:
    """n: the text's words. 1 for text whose words have a usual mean length, 1/2 otherwise, half of either where symbols are frequent."""
    length = F.coalesce(F.length(text), F.lit(0))
    symbols = length - F.coalesce(F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    usual = F.when((n > 0) & (length >= 4 * n) & (length <= 10 * n), F.lit(1.0)).otherwise(F.lit(0.5))
    return usual * F.when(symbols * 10 > n, F.lit(0.5)).otherwise(F.lit(1.0))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number above 0 and up to 1 that depends on the id alone, from 52 bits of md5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(1)).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes: one row per source with its size. Sources by code point, null last, get the weights in turn.

    The words to take are share times all words. A target stops at cap times its source's size; the excess goes to the
    other sources by weight. That fills up to a common level, which is the largest of the levels that come out when the
    sources are capped one by one in the order of cap/weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col(P + "source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank - 1) % len(weights) + 1)
    t = sizes.withColumn(P + "weight", weight).withColumn(P + "cap", F.col(P + "source_size").cast("double") * cap)
    every = Window.partitionBy()
    before = Window.orderBy(F.col(P + "cap") / F.col(P + "weight"), F.col(P + "source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.lit(share) * F.sum(P + "source_size").over(every) - F.coalesce(F.sum(P + "cap").over(before), zero)) / (
        F.sum(P + "weight").over(every) - F.coalesce(F.sum(P + "weight").over(before), zero)
    )
    t = t.withColumn(P + "level", level).withColumn(P + "level", F.max(P + "level").over(every))
    return t.withColumn(P + "target", F.least(P + "cap", F.col(P + "weight") * F.col(P + "level"))).drop(P + "weight", P + "cap", P + "level")


def measured(docs: DataFrame, *columns: str, text: str, doc_id: str, source: str, seed: str, weight: Column | None) -> DataFrame:
    """The named columns, and source, size, key and a hash of the text; written once, so that texts are counted once."""
    base = docs.withColumn(P + "size", word_count(F.col(text)))
    w = weight if weight is not None else quality_weight(F.col(text), F.col(P + "size"))
    own = {"source": F.col(source), "id": F.col(doc_id), "key": -F.log(uniform(F.col(doc_id), seed)) / w, "hash": F.xxhash64(text)}
    return stage(base.select(*columns, P + "size", *(c.alias(P + n) for n, c in own.items())), "mix-measured")


def mix_core(base: DataFrame, *, weights, share, cap) -> DataFrame:
    """base, as measured, with source size, target, whole epochs and taken words in columns that start with __mix_."""
    base = base.withColumn(P + "range", F.floor((1 - F.exp(-F.col(P + "key"))) * BUCKETS).cast("int"))

    ranges = base.groupBy(P + "source", P + "range").agg(F.sum(P + "size").alias(P + "sum"))
    ranges = stage(ranges, "mix-ranges")
    sizes = ranges.groupBy(P + "source").agg(F.sum(P + "sum").alias(P + "source_size"))
    goal = targets(sizes, weights, share, cap)
    size = F.col(P + "source_size")
    epochs = F.when(size > 0, F.floor(F.col(P + "target") / size)).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn(P + "epochs", epochs)
    goal = goal.withColumn(P + "rest", F.round(F.col(P + "target") - F.col(P + "epochs") * size).cast("long"))

    running = Window.partitionBy(P + "source").orderBy(P + "range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goal = goal.withColumnRenamed(P + "source", P + "s")
    edge = ranges.withColumn(P + "upto", F.sum(P + "sum").over(running)).join(goal, F.col(P + "source").eqNullSafe(F.col(P + "s")))
    edge = edge.where((F.col(P + "upto") >= F.col(P + "rest")) & (F.col(P + "upto") - F.col(P + "sum") < F.col(P + "rest")))
    edge = edge.select(F.col(P + "s").alias(P + "e"), F.col(P + "range").alias(P + "edge"), (F.col(P + "upto") - F.col(P + "sum")).alias(P + "before"))
    plan = goal.join(edge, F.col(P + "s").eqNullSafe(F.col(P + "e")), "left").drop(P + "e")
    plan = stage(plan.withColumns({P + "edge": F.coalesce(P + "edge", F.lit(-1)), P + "before": F.coalesce(P + "before", F.lit(0).cast("long"))}), "mix-plan")
    discard(ranges)
    few = plan.count() <= BROADCAST_SOURCES
    rows = base.join(F.broadcast(plan) if few else plan, F.col(P + "source").eqNullSafe(F.col(P + "s")))

    inside = F.when(F.col(P + "range") < F.col(P + "edge"), F.col(P + "size")).otherwise(F.lit(0).cast("long"))
    clear = rows.where(F.col(P + "range") != F.col(P + "edge")).withColumn(P + "part", inside)
    order = Window.partitionBy(P + "source").orderBy(P + "key", F.col(P + "id").asc_nulls_last(), P + "size", P + "hash")
    prior = F.sum(P + "size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(P + "size") + F.col(P + "before")
    at_edge = rows.where(F.col(P + "range") == F.col(P + "edge"))
    at_edge = at_edge.withColumn(P + "part", F.greatest(F.lit(0).cast("long"), F.least(F.col(P + "size"), F.col(P + "rest") - prior)))
    both = clear.unionByName(at_edge)
    return both.withColumn(P + "taken", F.col(P + "epochs") * F.col(P + "size") + F.col(P + "part"))


def mix_sources(docs: DataFrame, *, text="text", doc_id="doc_id", source="source", weights=(5, 2, 1), share=1.5, cap=2.0, seed="mix", weight: Column | None = None) -> DataFrame:
    """One row per document: its id, source, size, source_size, target, epochs, taken (words taken, repeats counted).

    The last document that a budget reaches gives only the words that are still missing, so a source's taken words equal
    its target rounded. Null text has size 0 and takes nothing; a null source is a source; a source without words has
    target 0; rows that repeat an id share a key and are taken in the order of size and text. An empty table gives an
    empty table. Other columns of docs are left out, so none can clash.
    """
    m = mix_core(measured(docs, text=text, doc_id=doc_id, source=source, seed=seed, weight=weight), weights=weights, share=share, cap=cap)
    names = {n: F.col(P + n) for n in ("size", "source_size", "target", "epochs", "taken")}
    return m.select(F.col(P + "id").alias("doc_id"), F.col(P + "source").alias("source"), *(c.alias(n) for n, c in names.items()))


def mixed_documents(docs: DataFrame, *, text="text", doc_id="doc_id", source="source", weights=(5, 2, 1), share=1.5, cap=2.0, seed="mix", weight: Column | None = None) -> DataFrame:
    """The mix itself: whole documents in the columns of docs, repeated once per epoch.

    The document at the end of a budget is in if at least half of it is taken. Documents without words (null, empty,
    blank) are in no mix. Null sources and repeated ids as in mix_sources. An empty table gives an empty table.
    """
    # docs' own columns go along in one, so that no name can clash
    own = docs.select(F.struct("*").alias("row"), *[F.col(c).alias(n) for c, n in ((text, "text"), (doc_id, "doc_id"), (source, "source"))])
    m = mix_core(measured(own, "row", text="text", doc_id="doc_id", source="source", seed=seed, weight=weight), weights=weights, share=share, cap=cap)
    copies = F.col(P + "epochs") + F.when((F.col(P + "part") > 0) & (F.col(P + "part") * 2 >= F.col(P + "size")), 1).otherwise(0)
    m = m.where(F.col(P + "size") > 0).withColumn(P + "copy", F.explode(F.sequence(F.lit(0), F.lit(int(cap) + 1))))
    return m.where(F.col(P + "copy") < copies).select("row.*")
