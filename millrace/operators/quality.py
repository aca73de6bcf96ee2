"""Scores of extractions, coverage, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.prices import blank


def rows() -> Column:
    return F.count(F.lit(1))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def already_usd(df: DataFrame, file: str, price: str, order: str, sample: int = 10, limit: float = 300.0) -> DataFrame:
    """Per file whether most of its first `sample` prices look like dollars, being below limit."""
    first = df.where(F.col(price) > 0).withColumn("rn", F.row_number().over(Window.partitionBy(file).orderBy(order))).where(F.col("rn") <= sample)
    return first.groupBy(file).agg((F.avg(F.when(F.col(price) < limit, 1.0).otherwise(0.0)) > 0.5).alias("usd"))


def with_score(df: DataFrame, year: int) -> DataFrame:
    return df.withColumn("score", M.score_row(F.col("model"), F.col("price_rmb"), F.col("spec_zh"), year))


def score_frame(df: DataFrame, keys: list[str], year: int) -> DataFrame:
    """Average row score with its bonus for distinct models, prices and little noise."""
    d = with_score(df, year)
    model = F.when(M.is_valid_model(F.col("model"), strict=False), blank(F.col("model")))
    g = d.groupBy(*keys).agg(rows().alias("count"), F.round(F.avg("score"), 1).alias("avg"), count_if(F.col("score") >= 5).alias("real_models"), count_if((F.col("score") >= 5) & (F.col("price_rmb") > 0)).alias("prices"), F.countDistinct(model).alias("distinct_models"), count_if(F.col("score") <= -2).alias("noise"))
    bonus = F.when(F.col("distinct_models") >= 3, 3).otherwise(0) + F.when(F.col("prices") >= 3, 2).otherwise(0) + F.when((F.col("noise") / F.col("count") < 0.2) & (F.col("count") >= 3), 1).otherwise(0)
    return g.select(*keys, "count", "real_models", "prices", F.round(F.col("avg") + bonus / F.col("count"), 6).alias("score"))


def score_result(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, models, prices and the variety of models of a candidate, halved if most models are placeholders."""
    m = F.coalesce("model", F.lit(""))
    g = df.groupBy(*keys).agg(rows().alias("n"), count_if(F.length(blank(m)) > 1).alias("models"), count_if(F.col("price_rmb") > 0).alias("prices"), F.countDistinct(F.when(m != "", F.lower(blank(m)))).alias("kinds"), count_if(m.startswith("产品_")).alias("made_up"))
    score = F.col("n") * 0.3 + F.col("models") * 0.3 + F.col("prices") * 0.2 + F.col("kinds") / F.greatest("models", F.lit(1)) * 2
    return g.select(*keys, F.round(F.when(F.col("made_up") > F.col("n") * 0.5, score * 0.5).otherwise(score), 6).alias("score"))


def parser_winner(df: DataFrame, year: int) -> DataFrame:
    """Per file the parser with more rows that score above 0, of equals the higher frame score, then the first name."""
    good = with_score(df, year).groupBy("file", "parser").agg(count_if(F.col("score") > 0).alias("good"))
    s = good.join(score_frame(df, ["file", "parser"], year).select("file", "parser", "score"), ["file", "parser"])
    best = Window.partitionBy("file").orderBy(F.desc("good"), F.desc("score"), "parser")
    return s.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def candidate_winner(df: DataFrame, table: str, strategy: str, content: str, factor: float = 1.5) -> DataFrame:
    """Per table the best layout candidate, unless the content candidate scores over factor times as much."""
    s = score_result(df, [table, strategy])
    is_content = F.col(strategy) == content
    g = s.groupBy(table).agg(F.max_by(strategy, F.when(~is_content, F.struct("score", strategy))).alias("layout"), F.max(F.when(~is_content, F.col("score"))).alias("layout_score"), F.max(F.when(is_content, F.col("score"))).alias("content_score"))
    use = F.col("layout").isNull() | (F.col("content_score") > factor * F.col("layout_score"))
    return g.select(table, F.when(use, F.lit(content)).otherwise(F.col("layout")).alias("winner"))


def coverage(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    there = sum((F.count(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1)) for c in columns[1:]), F.count(F.when(F.col(columns[0]).isNotNull() & (F.col(columns[0]).cast("string") != ""), 1)))
    return df.groupBy(key).agg(F.round(there / (rows() * len(columns)), 6).alias("coverage"))


def default_currency(df: DataFrame, file: str, limit: float = 500.0) -> DataFrame:
    """A file without any currency gets one by its mean positive price."""
    g = df.groupBy(file).agg(F.max(F.when(F.col("currency") != "", 1)).alias("known"), F.avg(F.when(F.col("price_rmb") > 0, F.col("price_rmb"))).alias("mean"))
    g = g.where("known is null").select(F.col(file).alias("f"), F.when(F.col("mean") > limit, "USD").otherwise("CNY").alias("guess"))
    return df.join(g, F.col(file) == F.col("f"), "left").withColumn("currency", F.coalesce("guess", "currency")).drop("f", "guess")


def eval_accuracy(expected: DataFrame, parsed: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per file: rates of count, model, price, name and specification keyword hits, and their weighted score."""
    key = lambda c: F.lower(blank(F.col(c)))
    first = parsed.withColumn("mk", key("model")).withColumn("rn", F.row_number().over(Window.partitionBy("file", "mk").orderBy("row_no"))).where("rn = 1")
    first = first.select(F.col("file").alias("pf"), "mk", F.col("price_rmb").alias("got"), F.col("name_zh").alias("got_name"), F.col("spec_zh").alias("got_spec"))
    e = expected.join(first, (F.col("file") == F.col("pf")) & (key("model") == F.col("mk")), "left")
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    near = F.abs(F.col("got") - F.col("price_rmb")) <= F.col("price_rmb") * F.col("tolerance") / 100
    g = e.groupBy("file").agg(rows().alias("expected"), rate(F.col("pf").isNotNull()).alias("model"), rate(near).alias("price"), rate(F.col("got_name").contains(F.col("name_keyword"))).alias("name"), rate(F.col("got_spec").contains(F.col("spec_keyword"))).alias("spec"))
    g = g.join(parsed.groupBy("file").agg(rows().alias("parsed")), "file")
    count = F.when(F.col("parsed") == F.col("expected"), 1.0).when(F.abs(F.col("parsed") - F.col("expected")) <= F.col("expected"), 0.5).otherwise(0.0)
    score = F.round(count * 0.35 + F.col("model") * 0.30 + F.col("price") * 0.15 + F.col("name") * 0.15 + F.col("spec") * 0.05, 2)
    return g.select("file", count.alias("count_score"), F.round("model", 4).alias("model"), F.round("price", 4).alias("price"), F.round("name", 4).alias("name"), F.round("spec", 4).alias("spec"), score.alias("score"), (score >= threshold).alias("passes"))
