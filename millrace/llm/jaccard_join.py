"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; texts with the same set are one class and are worked on once. A class gets
a signature of SIGNS min-hash tokens, on which two sets agree at a position with the chance of their similarity.

Paths: in every run a class starts on the path of one sampled token and meets on it the classes that have the same token.
Buckets of one are dropped and small ones are leaves. A larger bucket splits again on BRANCHES tokens sampled for its
path, and so on; a bucket that hardly shrinks is of alike sets and becomes a leaf as it is, and so does one at the last
level. Runs are repeated until two sets at the threshold miss each other with a chance of 1 - RECALL at most, even where
they must be split at every level: 12 at 0.8.

In a leaf all signatures are compared and classes that agree at so many places as sets at the threshold do but for a
chance of 1 - RECALL are tied together; of each tied part only a tree of links leaves the task. The parts that this gives over all leaves (components) hold every pair
in question. Then the true sets of a part are compared, each pair once, by products of 0/1 matrices. What leaves a task
is, for each class, its number of links and the smallest class it is tied to. No pairs are written at any time. Leaves
and parts of more than a block are split into pairs of blocks, which are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, stage, text_id
from .components import components
from .words import blocks, split_words

WORDS = 5
SIMILARITY = 0.8
SIGNS = 64
RECALL = 1 - 1e-7
BRANCHES = 2
LEVELS = 8
LEAF = 200
DENSE = 0.5
LEAF_BLOCK = 1000
SET_BLOCK = 500
SET_BYTES = 64_000_000
BLOCK = 2_000_000

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 2**63, SIGNS, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 2**63, SIGNS, dtype=np.uint64)
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def runs_for(similarity: float, recall: float, levels: int) -> int:
    """Runs after which two sets of that similarity have met with the chance `recall`, split at every level."""
    stay = 1.0  # the chance to be together in a leaf, once on a path together
    for _ in range(levels - 1):
        stay = 1 - (1 - similarity * stay) ** BRANCHES
    runs = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity * stay)))
    if runs > SIGNS:
        raise ValueError(f"a recall of {recall} at similarity {similarity} takes more than {SIGNS} runs")
    return max(runs, 1)


def agreeing(similarity: float, recall: float) -> int:
    """Places at which the signatures of two sets of that similarity agree at least, with the chance `recall`."""
    below = 0.0
    for k in range(SIGNS + 1):
        below += comb(SIGNS, k) * similarity**k * (1 - similarity) ** (SIGNS - k)
        if below > 1 - recall:
            return k
    return SIGNS


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that leaves no pattern."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted 64-bit shingles of each text; a text of fewer words is one shingle, a text without words has none."""
    import xxhash

    codes, starts, distinct = split_words([t.encode() for t in texts])
    with np.errstate(over="ignore"):
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))[codes]
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own, n = h[a:b], min(words, b - a)
            total = np.zeros(max(b - a - n + 1, 0) if n else 0, dtype=np.uint64)
            for k in range(n):
                total += spread(own[k : len(own) - n + 1 + k] + np.uint64(k + 1)) * PLACES[k]
            out.append(np.unique(spread(total + np.uint64(n))))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """SIGNS min-hash tokens of 32 bits."""
    best = np.full(SIGNS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 20_000):
            best = np.minimum(best, (s[at : at + 20_000, None] * MULTIPLY + ADD).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def class_of(s: np.ndarray) -> int:
    """64 bits for a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def check_of(s: np.ndarray) -> int:
    """64 more, by which sets of one class_of are told apart."""
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - 2**63


def sketch(words: int, hashed: Callable) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "t", BLOCK):
            sets = shingle_sets(list(pdf["t"]), words)
            some = lambda f: pd.array([f(s) if len(s) else None for s in sets], dtype="Int64")  # noqa: E731, B023
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "cls": some(hashed), "check": some(check_of), "sig": [signature(s) if len(s) else None for s in sets]})

    return run


def sets_of(words: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "t", BLOCK):
            sets = shingle_sets(list(pdf["t"]), words)
            yield pdf.drop(columns=["t"]).assign(set=[s.tobytes() for s in sets], bytes=[8 * len(s) for s in sets])

    return run


def leaves(sigs: DataFrame, *, leaf: int, levels: int, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """(path, n, cls): the leaves that hold two classes or more, and their sizes; and the tables that they are read from."""
    start = F.array(*[F.xxhash64(F.lit(r), F.element_at("sig", int(p) + 1)) for r, p in enumerate(np.random.default_rng(5).permutation(SIGNS)[:runs])])
    now = sigs.select(F.explode(start).alias("path"), "cls", F.lit(None).cast("long").alias("parent"))
    done, tables = None, []
    for level in range(levels):
        paths = stage(now, "paths")
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = stage(sizes.withColumnRenamed("path", "p"), "paths-sizes")
        now = paths.join(sizes, F.col("path") == F.col("p")).drop("p")
        ends = (F.col("n") <= leaf) | (F.col("n") > F.col("parent") * DENSE) if level < levels - 1 else F.lit(True)
        ends = F.coalesce(ends, F.lit(False))
        now = stage(now.withColumn("ends", ends), "paths-kept")
        tables.append(now)
        discard(paths, sizes)
        found = now.where("ends").select("path", "n", "cls")
        done = found if done is None else done.unionByName(found)
        more = now.where("not ends")
        if more.isEmpty():
            break
        place = [F.pmod(F.xxhash64("path", F.lit(b)), F.lit(SIGNS)).cast("int") for b in range(BRANCHES)]
        step = F.array(*[F.xxhash64("path", F.lit(b), F.element_at("sig", place[b] + 1)) for b in range(BRANCHES)])
        now = more.withColumnRenamed("cls", "c").join(sigs, F.col("c") == F.col("cls")).select(F.explode(step).alias("path"), "cls", F.col("n").alias("parent"))
    return done, tables


def in_blocks(rows: DataFrame, group: str, parts: Column) -> DataFrame:
    """rows with the task they go to (group, i, j), whether i is j there, and whether they are of block i: a row of block b goes to every pair that b is in."""
    rows = rows.withColumn("parts", parts).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    rows = rows.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})
    return rows.withColumns({"first": F.col("b") == F.col("i"), "within": F.col("i") == F.col("j"), "task": F.xxhash64(group, "i", "j")}).drop("parts", "b", "o")


#: Clashing hashes up to this number are broadcast.
CLASHES = 100_000


def per_group(key: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable:
    """Applies work to the runs of equal keys in sorted batches; several results go out together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                pdf = pd.concat([*held, pdf], ignore_index=True) if (held[-1][key].iloc[-1] == pdf[key].iloc[0]).all() else pdf
                if len(pdf) and held and not (held[-1][key].iloc[-1] == pdf[key].iloc[0]).all():
                    yield from emit(pd.concat(held, ignore_index=True))
                held = []
            values = pdf[key].to_numpy()
            last = len(values) - 1
            while last > 0 and (values[last - 1] == values[-1]).all():
                last -= 1
            if last:
                yield from emit(pdf.iloc[:last])
            held = [pdf.iloc[last:].reset_index(drop=True)]
        if held:
            yield from emit(held[0])

    def emit(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        values = pdf[key].to_numpy()
        change = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        bounds = [0, *change, len(values)]
        found = [r for a, b in zip(bounds[:-1], bounds[1:], strict=True) if (r := work(pdf.iloc[a:b])) is not None and len(r)]
        if found:
            yield pd.concat(found, ignore_index=True)

    return run


def tied(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric 0/1 matrix is tied to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tie_leaf(need: int) -> Callable:
    """A tree of links for each part of a leaf whose signatures agree at `need` places or more."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        if len(pdf) < 2:
            return None
        cls, first = pdf["cls"].to_numpy(), pdf["first"].to_numpy()
        sig = np.stack(pdf["sig"].to_numpy())
        if len(pdf) == 2:
            return pd.DataFrame({"u": cls[1:], "v": cls[:1]}) if (sig[0] == sig[1]).sum() >= need else None
        agree = np.zeros((len(pdf), len(pdf)), dtype=np.uint8)
        for k in range(SIGNS):
            agree += sig[:, k, None] == sig[None, :, k]
        linked = agree >= need
        if not pdf["within"].iloc[0]:
            linked &= first[:, None] != first[None, :]
        label = tied(linked)
        far = label != np.arange(len(label))
        return pd.DataFrame({"u": cls[far], "v": cls[label[far]]})

    return work


def compare_sets(similarity: float) -> Callable:
    """Of each class in a task: classes and documents linked to it, and the smallest class that it is tied to."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        n = len(pdf)
        if n < 2:
            return None
        cls, first, docs = pdf["cls"].to_numpy(), pdf["first"].to_numpy(), pdf["docs"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        owner = np.repeat(np.arange(n), size.astype(np.int64))
        _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often[col] > 1
        owner, col = owner[shared], col[shared]
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        both = np.zeros((n, n), dtype=np.float32)
        width = 4096
        edges = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + width + 1, width))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                m = np.zeros((n, int(col[b - 1]) - k * width + 1), dtype=np.float32)
                m[owner[a:b], col[a:b] - k * width] = 1
                both += m @ m.T
        both = both.astype(np.float64)
        linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if not pdf["within"].iloc[0]:  # also where all rows are of one block: the other may be empty
            linked &= first[:, None] != first[None, :]
        if not linked.any():
            return None
        by_class = np.argsort(cls)
        label = np.empty(n, dtype=np.int64)
        label[by_class] = cls[by_class][tied(linked[np.ix_(by_class, by_class)])]
        some = linked.any(axis=1)
        return pd.DataFrame({"cls": cls, "links": linked.sum(axis=1), "linked_docs": linked @ docs, "label": label})[some]

    return work


def jaccard_join(docs: DataFrame, *, text="text", doc_id="doc_id", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, levels: int = LEVELS, leaf_block: int = LEAF_BLOCK, set_block: int = SET_BLOCK, hashed: Callable = class_of) -> DataFrame:
    """One row per document: doc_id, th (its text's hash), class_id, class_size, n_links, copies.

    n_links: other documents with similarity at least `similarity`, those with the same set included; copies: documents
    with the same set, itself included. A link is missed with a chance of 1 - recall at most. A class is what links tie together; its id is its smallest doc_id. Words are
    what ASCII white space parts. A text of one to four words is one shingle; null, empty and blank texts have none, no
    links, and a class of their own. A null id is never a class's id while another row has one. Repeated rows are
    documents of their own. An empty table gives an empty table. Other columns of docs are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    d = bounded_batches(docs).select(F.col(doc_id).alias("id"), text_id(doc_id), F.coalesce(text, F.lit("")).alias("t"))
    d = d.withColumn("th", F.xxhash64("t"))
    rows = d.select("doc_id", "th", "t").mapInPandas(sketch(words, hashed), "doc_id string, th long, cls long, check long, sig array<int>")
    rows = stage(rows.withColumn("doc_id", F.col("doc_id").cast(kind)), "jaccard-sketch")
    clash = stage(rows.groupBy("cls").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low != high").select(F.col("cls").alias("clashing")), "jaccard-clashes")
    if not clash.isEmpty():  # one hash for different sets: these get another one
        first, few = rows, clash.count() <= CLASHES
        anew = F.when(F.col("clashing").isNotNull(), F.xxhash64("cls", "check")).otherwise(F.col("cls"))
        rows = stage(first.join(F.broadcast(clash) if few else clash, F.col("cls") == F.col("clashing"), "left").withColumn("cls", anew).drop("clashing"), "jaccard-sketch")
        discard(first)
    discard(clash)
    rows = rows.drop("check")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("th"))).alias("one"), F.first("sig").alias("sig"))
    classes = stage(classes.select("cls", "docs", F.col("one.id").alias("id"), F.col("one.th").alias("one_th"), "sig"), "jaccard-classes")

    sigs = classes.select("cls", "sig")
    found, tables = leaves(sigs, leaf=leaf, levels=levels, runs=runs_for(similarity, recall, levels))
    tasks = in_blocks(found, "path", F.ceil(F.col("n") / leaf_block)).withColumnRenamed("cls", "c").join(sigs, F.col("c") == F.col("cls"))
    tasks = tasks.select("task", "first", "within", "cls", "sig").repartition("task").sortWithinPartitions("task", "cls")
    ties = tasks.mapInPandas(per_group(["task"], tie_leaf(agreeing(similarity, recall))), "u long, v long")
    parts = components(ties)
    discard(*tables)

    members = classes.drop("sig").join(parts, F.col("cls") == F.col("node")).select("cls", "docs", F.col("component").alias("part"), "id", "one_th")
    texts = d.join(members.withColumnRenamed("id", "one_id"), F.col("id").eqNullSafe(F.col("one_id")) & (F.col("th") == F.col("one_th")))
    texts = texts.select("cls", "docs", "part", "t").mapInPandas(sets_of(words), "cls long, docs long, part long, set binary, bytes long")
    texts = stage(texts, "jaccard-sets")
    sizes = texts.groupBy("part").agg(F.countDistinct("cls").alias("n"), F.sum("bytes").alias("all"))
    sizes = stage(sizes.withColumnRenamed("part", "p"), "jaccard-sizes")
    alone = Window.partitionBy("task", "cls", "first").orderBy("bytes")
    tasks = in_blocks(texts.join(sizes, F.col("part") == F.col("p")), "part", F.greatest(F.ceil(F.col("n") / set_block), F.ceil(F.col("all") / SET_BYTES)))
    tasks = tasks.withColumn("again", F.row_number().over(alone)).where("again = 1")  # a row that repeats id and text brings its set again
    tasks = tasks.select("task", "first", "within", "cls", "docs", "set").repartition("task").sortWithinPartitions("task", "cls")
    links = tasks.mapInPandas(per_group(["task"], compare_sets(similarity)), "cls long, links long, linked_docs long, label long")
    links = stage(links, "jaccard-links")
    discard(parts, texts, sizes)
    final = components(links.select(F.col("cls").alias("u"), F.col("label").alias("v")))
    counts = links.groupBy("cls").agg(F.sum("linked_docs").alias("linked_docs"))

    info = classes.drop("sig").join(final, F.col("cls") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cls"))
    info = info.where("docs > 1 or component is not null")
    ids = info.groupBy("part").agg(F.min("id").alias("class_id"), F.sum("docs").alias("class_size")).withColumnRenamed("part", "p")
    info = info.join(ids, F.col("part") == F.col("p")).join(counts.withColumnRenamed("cls", "lc"), F.col("cls") == F.col("lc"), "left")
    info = stage(info.select(F.col("cls").alias("ic"), "class_id", "class_size", "docs", (F.coalesce("linked_docs", F.lit(0)) + F.col("docs") - 1).alias("n_links")), "jaccard-classes-done")
    discard(classes, links, final)
    out = rows.drop("sig").join(info, F.col("cls") == F.col("ic"), "left")
    one = F.lit(1).cast("long")
    return out.select(
        "doc_id", "th", F.when(F.col("ic").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", one).alias("class_size"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("docs", one).alias("copies"),
    )


def one_of_each(docs: DataFrame, *, text="text", doc_id="doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: that with the smallest id (rows without an id come last; of rows that repeat
    an id, the one with the smallest text hash; of rows that repeat both, one).

    Null, empty and blank texts are classes of their own and stay. An empty table gives an empty table. Rows come back as
    they are, whatever other columns are called.
    """
    found = jaccard_join(docs, text=text, doc_id=doc_id, words=words, similarity=similarity)
    # classes of one stay; of others, the row that comes first. Only those others are grouped.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    several = found.where("class_size > 1")
    first = several.groupBy("class_id").agg(F.min(place).alias("first")).select("first.id", "first.th")
    stay = found.where("class_size = 1").select(F.col("doc_id").alias("id"), "th").unionByName(first)
    stay = stage(stay.groupBy("id", "th").agg(F.count(F.lit(1)).alias("copies")), "jaccard-stay")
    # docs' own columns go along in one column, so that no name can clash
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_th"))
    out = own.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("own_id", "own_th").orderBy("own_th")))
    return out.where("n <= copies").select("row.*")
