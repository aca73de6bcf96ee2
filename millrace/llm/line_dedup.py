"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides after which lines a chunk ends, so that a passage is cut
alike wherever it stands. A line of LONG words or more is a chunk of its own. Chunks of several lines, and long lines,
that occur more than once in the corpus are removed everywhere but at their first place (smallest doc_id, then
position). What repeats is decided on the chunks' bytes.

Chunks end inside a passage and share lines with its surroundings, so most of a passage of short lines would stay. So
runs are compared as well: from each line on, and up to each line, the fewest lines that make up LONG words. They hang
on nothing outside them and together cover every line of a passage of LONG words or more, which so goes whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, stage, word_count

DIVISOR = 2
LONG = 50


def line_hash(line: Column) -> Column:
    """32 bits of md5, as a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunk_structs(text: Column, divisor: int = DIVISOR, long: int = LONG) -> Column:
    """Array of (start: first line from 0, lines, chunk: text), in order, covering the text."""
    lines = F.split(text, "\n", -1)
    facts = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), (word_count(x) >= long).alias("long")))

    def is_end(f: Column, i: Column) -> Column:
        here, after = F.element_at(f, i), F.element_at(f, F.least(i + 1, F.size(f)))
        before = F.when(i > 1, F.element_at(f, F.greatest(i - 1, F.lit(1)))["h"]).otherwise(F.lit(0).cast("long"))
        return (i == F.size(f)) | here["long"] | after["long"] | ((before * 31 + here["h"]) % divisor == 0)

    def stops(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(s["f"])), lambda i: is_end(s["f"], i))

    def cut(s: Column):
        def one(stop: Column, k: Column) -> Column:
            start = F.when(k > 0, F.element_at(s["stops"], F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
            chunk = F.array_join(F.slice(s["l"], start + 1, stop - start), "\n")
            return F.struct(start.alias("start"), (stop - start).alias("lines"), chunk.alias("chunk"))

        return one

    # a transform over one element names a value, so that it is computed once a row
    one = F.transform(F.array(F.struct(lines.alias("l"), facts.alias("f"))), lambda s: F.struct(s["l"].alias("l"), stops(s).alias("stops")))
    return F.flatten(F.transform(one, lambda s: F.transform(s["stops"], cut(s))))


def is_candidate(c: Column, long: int = LONG) -> Column:
    """Several lines with a word among them, or one long line."""
    return ((c["lines"] > 1) & c["chunk"].rlike(WORD)) | (word_count(c["chunk"]) >= long)


def line_runs(docs: DataFrame, text: str, doc_id: str, long: int = LONG) -> DataFrame:
    """(id, th, start, end, run): runs of two or more lines, from line start to line end, and 128 bits of SHA-256 of their lines.

    Lines without a word don't count: a run is the same with or without them.
    """
    # the hash is taken before texts are taken apart, else Spark takes it again for every line
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))
    lines = lines.select("id", "th", F.posexplode_outer("lines").alias("at", "line"))  # outer: see deduped
    lines = lines.select("id", "th", "at", word_count(F.col("line")).alias("w"), F.substring(F.sha2(F.col("line").cast("binary"), 256), 1, 32).alias("h")).where("w > 0")
    lines = lines.repartition("id", "th").dropDuplicates(["id", "th", "at"])  # rows that repeat id and text are one document
    doc = Window.partitionBy("id", "th")
    lines = lines.withColumn("after", F.sum("w").over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("w"))
    onward, back = doc.orderBy("before").rangeBetween(0, long - 1), doc.orderBy("after").rangeBetween(1 - long, 0)

    def run(frame, start: Column, end: Column, known: Column) -> Column:
        hs, words = F.collect_list("h").over(frame), F.sum("w").over(frame)
        whole = (F.size(hs) > 1) & (words >= long) & ~known
        return F.when(whole, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(F.unhex(F.sha2(F.array_join(hs, "").cast("binary"), 256)), 1, 16).alias("run")))

    # a run up to a line that is also the one from its first line on is named once
    forward = run(onward, F.col("at"), F.max("at").over(onward), F.lit(False))
    backward = run(back, F.min("at").over(back), F.col("at"), F.sum("w").over(back) - F.col("w") < long)
    both = lines.select("id", "th", forward.alias("f"), backward.alias("b")).select("id", "th", F.explode(F.array("f", "b")).alias("r"))
    return both.where("r is not null").select("id", "th", "r.*")


def repeated_runs(docs: DataFrame, text: str, doc_id: str, long: int = LONG) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(id, th, start, lines) of the runs that stand elsewhere first, and the staged tables that this reads. Where a run
    overlaps its own first place, that place stays."""
    runs = stage(line_runs(docs, text, doc_id, long), "lines-runs")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("start").alias("start"), F.col("end").alias("end"))
    firsts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = stage(firsts.select(F.col("run").alias("rr"), "first"), "lines-runs-repeated")
    again = runs.withColumn("place", place).join(firsts, F.col("run") == F.col("rr")).where(F.col("place") != F.col("first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    start = F.when(same, F.greatest(F.col("start"), F.col("first.end") + 1)).otherwise(F.col("start"))
    return again.select("id", "th", start.alias("start"), (F.col("end") - start + 1).alias("lines")).where("lines > 0"), (runs, firsts)


def deduped(docs: DataFrame, text: str, doc_id: str, divisor: int, long: int, runs: bool, hashed) -> DataFrame:
    """(row: docs' own columns, text: what stays, lines, removed: both long). docs' columns travel in one, so that none
    can clash with those made here."""
    key, th = F.col(doc_id), F.xxhash64(text)
    kept = F.filter(chunk_structs(F.col(text), divisor, long), lambda c: is_candidate(c, long))
    # the hash is taken before texts are taken apart, else Spark takes it again for every chunk; outer, as for the plain
    # form Spark puts a filter on the array's size before it and so cuts each text twice
    occ = docs.where(F.col(text).isNotNull()).select(key.alias("id"), th.alias("th"), kept.alias("chunks"))
    occ = occ.select("id", "th", F.explode_outer("chunks").alias("c")).where("c is not null")
    occ = occ.select("id", "th", F.col("c.start").alias("start"), F.col("c.lines").alias("lines"), F.col("c.chunk").alias("chunk"), hashed(F.col("c.chunk")).alias("h"))
    occ = stage(occ, "lines-chunks")  # written once, with the chunks' bytes, which only the comparison reads
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("start").alias("start"))

    classes = occ.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    slim = classes.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).where("n > 1")
    slim = stage(slim.select(F.col("h").alias("rh"), "texts", "first"), "lines-repeated")
    once, several = slim.where("texts = 1"), slim.where("texts > 1")
    again = occ.select("id", "th", "start", "lines", "h", place.alias("place")).join(once, F.col("h") == F.col("rh"))
    again = again.where(F.col("place") != F.col("first")).select("id", "th", "start", "lines")
    if not several.isEmpty():  # one hash for different bytes: these few are compared as texts
        those = occ.join(several, F.col("h") == F.col("rh"), "left_semi")
        firsts = those.groupBy("chunk").agg(F.min(place).alias("first")).withColumnRenamed("chunk", "rc")
        more = those.withColumn("place", place).join(firsts, F.col("chunk") == F.col("rc")).where(F.col("place") != F.col("first"))
        again = again.unionByName(more.select("id", "th", "start", "lines"))
    more, used = repeated_runs(docs, text, doc_id, long) if runs else (None, ())
    again = again.unionByName(more) if runs else again
    gone = stage(islands(again).groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")), "lines-gone")
    discard(occ, slim, *used)

    own = docs.select(F.struct("*").alias("row"), key.alias("own_id"), th.alias("own_th"))
    # by merging at every size: what goes grows with the texts, and a broadcast would end where it matters
    out = own.join(gone.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    t = F.col("row").getField(text)
    some, split = F.col("gone").isNotNull(), F.split(t, "\n", -1)
    lines = F.when(t.isNull(), 0).otherwise(F.size(split)).cast("long")
    removed = F.aggregate("gone", F.lit(0), lambda n, g: n + g["end"] - g["start"])
    # a transform over one element names the lines, so that a text is split once
    stay = F.element_at(F.transform(F.array(split), between_gaps), 1)
    return out.select("row", F.when(some, stay).otherwise(t).alias("text"), lines.alias("lines"), F.when(some, removed).otherwise(F.lit(0)).cast("long").alias("removed"))


def islands(intervals: DataFrame) -> DataFrame:
    """(id, th, start, end): a text's lines from start on and before end, intervals that overlap or touch made one."""
    w = Window.partitionBy("id", "th").orderBy("start", "lines")
    i = intervals.withColumn("end", F.col("start") + F.col("lines"))
    i = i.withColumn("upto", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("island", F.sum(F.when(F.col("start") <= F.col("upto"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("id", "th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def between_gaps(lines: Column) -> Column:
    """The lines outside the islands in column gone, joined."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), "gone", F.array(F.struct(F.size(lines).alias("start"), F.size(lines).alias("end"))))

    def piece(edge: Column, i: Column) -> Column:
        start = F.element_at(edges, i)["end"]
        return F.slice(lines, start + 1, edge["start"] - start)

    return F.array_join(F.flatten(F.transform(F.slice(edges, 2, F.size(edges) - 1), lambda e, i: piece(e, i + 1))), "\n")


def line_dedup(docs: DataFrame, *, text="text", doc_id="doc_id", divisor: int = DIVISOR, long: int = LONG, runs: bool = True, hashed=F.xxhash64) -> DataFrame:
    """docs with text replaced by what stays, and __lines, __removed_lines (both long; columns of docs that are called so
    give way): rows and other columns as they were.

    Null text stays null and has 0 lines; empty text has one line. A text that loses every line becomes empty. Rows that
    repeat both id and text are one document and are treated alike. A null id comes after all others in the choice of the
    first place. An empty table gives an empty table. runs=False compares chunks only.
    """
    out = deduped(docs, text, doc_id, divisor, long, runs, hashed)
    counts = {"__lines": F.col("lines"), "__removed_lines": F.col("removed")}
    return out.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in counts], *[v.alias(k) for k, v in counts.items()])


def dedup_lines(docs: DataFrame, *, text="text", doc_id="doc_id", chars: str | None = "n_chars", divisor: int = DIVISOR, long: int = LONG) -> DataFrame:
    """docs in their own columns after line dedup: changed texts have their length put in `chars`, if docs has such a
    column, and a document of which no word is left goes. Others stay as they are, null and empty texts too; repeats and
    null ids as in line_dedup. An empty table gives an empty table."""
    out = deduped(docs, text, doc_id, divisor, long, True, F.xxhash64)
    changed = F.col("removed") > 0
    out = out.where(~changed | F.col("text").rlike(WORD))

    def column(c: str) -> Column:
        if c == text:
            return F.col("text")
        own = F.col("row").getField(c)
        return F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(own) if c == chars else own

    return out.select(*[column(c).alias(c) for c in docs.columns])
