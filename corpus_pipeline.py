"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate join, source mix, packing.

Every stage takes any columns beside those of documents, under any names, and (but for packing) returns them as they
came. An empty table gives an empty one in every stage, and so in run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common
from millrace.llm.common import table
from millrace.llm.jaccard_join import one_of_each
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.mixing import mixed_documents
from millrace.llm.packing import pack
from millrace.llm.quality_rules import passing
from millrace.llm.registry import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and short texts go; null languages are held against all together; rows that
    repeat stay or go alike; null ids and ids of any size are kept as they are."""
    return passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere first, n_chars brought up to date; one that loses all its words goes.
    Null and empty texts stay; of places the smallest id comes first, null last; rows that repeat id and text are one."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, null last. Rows that repeat id and text give
    one; texts without words are no duplicates."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeated as often as it takes them. A null source is a source; documents without words are in no
    mix; a null id draws like any other, and rows that repeat one are taken in the order of size and text."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. Null and empty texts have the end token alone; repeats are packed each."""
    return pack(docs, tokenizer=vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix), ("packing", packing)]

#: Shingle classes, language references and token ids are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again for the next, and go
    once that has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), "pipeline")
        common.discard(before)
        before = docs
    return docs
