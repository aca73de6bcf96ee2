"""The product library: lists, searches, lookups, upserts, patches, deletes, imports."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import strip


def for_user(df: DataFrame, user: str) -> DataFrame:
    return df.where(F.col("user_id") == user)


def list_products(df: DataFrame, user: str, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    d = for_user(df, user)
    d = d.where(F.col("category") == category) if category else d
    return d.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def search_products(df: DataFrame, user: str, keyword: str, limit: int = 50) -> DataFrame:
    """Case-insensitive LIKE in sku and names, the field that hits giving the rank; % and _ in the keyword are wildcards."""
    like = f"%{keyword}%"
    rank = F.when(F.col("sku").ilike(like), 1).when(F.col("name_zh").ilike(like), 2).when(F.col("name_en").ilike(like), 3)
    return for_user(df, user).withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", "id").limit(limit)


def search_substring(df: DataFrame, keyword: str, *columns: str) -> DataFrame:
    return df.where(reduce(or_, (F.lower(F.coalesce(c, F.lit(""))).contains(keyword.lower()) for c in columns))) if keyword else df


def price_between(price: Column, low: float | None, high: float | None) -> Column:
    """Null prices fail; a bound of 0 or None is no bound."""
    return reduce(and_, [price.isNotNull(), *([price >= low] if low else []), *([price <= high] if high else [])])


def keyword_filter(field: Column, words: list[str], include: bool = True) -> Column:
    text = F.lower(F.coalesce(field, F.lit("")))
    hit = reduce(or_, (text.contains(w.lower()) for w in words), F.lit(False))
    return hit if include else ~hit


def cert_filter(field: Column, codes: list[str]) -> Column:
    text = F.upper(F.coalesce(field, F.lit("")))
    return reduce(or_, (text.contains(c.upper()) for c in codes), F.lit(False))


def regex_filter(field: Column, pattern: str) -> Column:
    return F.coalesce(field, F.lit("")).rlike(pattern)


def filter_chain(df: DataFrame, *predicates: Column) -> DataFrame:
    return df.where(reduce(and_, predicates, F.lit(True)))


def nl_predicate(question: str, columns: list[str]) -> Column:
    """Rules for questions on price: words for more give a lower bound (the first number), words for less an upper one (the last)."""
    import re

    numbers = re.findall(r"\d+(?:\.\d+)?", question)
    low = question.lower()
    if not numbers or not any(w in low for w in ("price", "价格", "单价")):
        return F.lit(True)
    price = F.col("price_usd" if "price_usd" in columns else "price_rmb")
    parts = []
    if any(w in low for w in ("大于", "高于", "超过", "above", "over", "greater", ">")):
        parts.append(price > float(numbers[0]))
    if any(w in low for w in ("小于", "低于", "少于", "below", "under", "less", "<")):
        parts.append(price < float(numbers[-1]))
    return reduce(and_, parts, F.lit(True))


def leaks(sku: Column) -> Column:
    """A line break in it, or a colon among its first 15 characters."""
    return sku.contains("\n") | F.instr(sku, ":").between(1, 15)


def lookup_by_skus(df: DataFrame, user: str, skus: DataFrame) -> DataFrame:
    """One row per sku of the list that the user has, the one with the smallest id."""
    found = for_user(df, user).join(skus.select("sku").distinct(), "sku", "left_semi")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("sku").orderBy("id"))).where("rn = 1").drop("rn")


def user_priority(user: Column) -> Column:
    return F.when(user == "ev_alls", 0).when(user == "local", 1).otherwise(2)


def first_per_sku(df: DataFrame) -> DataFrame:
    """One row per sku over all users: shared library first, then local, then others; then by id."""
    order = F.struct(user_priority(F.col("user_id")).alias("p"), F.col("id").alias("id"))
    best = df.groupBy("sku").agg(F.min(order).alias("best"))
    return df.join(best.select(F.col("best.id").alias("best_id"), F.col("sku").alias("best_sku")), (F.col("id") == F.col("best_id")) & F.col("sku").eqNullSafe(F.col("best_sku"))).drop("best_id", "best_sku")


def lookup_by_ids(df: DataFrame, ids: DataFrame, user: str | None = None) -> DataFrame:
    d = df.join(ids.select("id").distinct(), "id", "left_semi")
    d = for_user(d, user) if user else d
    return first_per_sku(d.where(~leaks(F.col("sku"))))


def order_match(lines: DataFrame, library: DataFrame) -> DataFrame:
    """Order lines with the product of their stripped sku and user, smallest id of several; quantity 1 where unreadable."""
    one = library.groupBy("user_id", "sku").agg(F.min("id").alias("id"), F.min_by("price_rmb", "id").alias("price_rmb"))
    lines = lines.withColumns({"sku": strip(F.col("sku")), "qty": F.coalesce(F.col("qty").try_cast("int"), F.lit(1))})
    return lines.join(one, ["user_id", "sku"], "left")


def order_not_found(lines: DataFrame, library: DataFrame) -> DataFrame:
    return lines.withColumn("sku", strip(F.col("sku"))).join(library.select("user_id", "sku"), ["user_id", "sku"], "left_anti")


def upsert(library: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """Library after a batch keyed by (user_id, sku): listed fields are replaced, new keys are added; of several incoming
    rows of a key the one with the greatest id counts."""
    key = ["user_id", "sku"]
    latest = incoming.groupBy(*key).agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in key]), "id").alias("new"))
    both = library.join(latest, key, "left")
    updated = both.select(*[(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)) for c in library.columns])
    added = latest.join(library.select(*key).distinct(), key, "left_anti").select(*key, "new.*")
    return updated.unionByName(added.select(*[c for c in library.columns if c in added.columns]), allowMissingColumns=True)


def patch(library: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Library with the non-null fields of changes (one row per id) put in."""
    c = changes.select("id", *[F.col(f).alias("new_" + f) for f in fields])
    return library.join(c, "id", "left").select(*[(F.coalesce("new_" + x, x).alias(x) if x in fields else F.col(x)) for x in library.columns])


def delete(library: DataFrame, ids: DataFrame, user: str) -> DataFrame:
    gone = ids.select(F.col("id").alias("gone")).distinct()
    return library.join(gone, (F.col("id") == F.col("gone")) & (F.col("user_id") == user), "left_anti")


def delete_count(library: DataFrame, ids: DataFrame, user: str) -> DataFrame:
    return for_user(library, user).join(ids.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def migrate_missing(target: DataFrame, source: DataFrame, defaults: dict) -> DataFrame:
    """Target and those source rows whose id it lacks, in the target's types, defaults for null."""
    new = source.join(target.select("id"), "id", "left_anti")
    kinds = dict(target.dtypes)
    cols = [F.coalesce(F.col(c).try_cast(kinds[c]), F.lit(defaults[c]).cast(kinds[c])).alias(c) if c in defaults else F.col(c).try_cast(kinds[c]).alias(c) for c in target.columns]
    return target.unionByName(new.select(*cols))


def suffix(n: Column) -> Column:
    """-A to -Z for 0 to 25, then -AA to -ZZ; then the first letter goes on through the characters after Z, as in the reference.

    Halves of surrogate pairs are no characters and are passed over; beyond the last character (29 million) it fails."""
    code = F.floor((n - 26) / 26) + 65
    code = code + F.when(code >= 0xD800, 0x800).otherwise(0)
    first = F.when(code < 0x80, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.concat(F.lit("-"), F.when(n >= 26, first).otherwise(""), F.chr(n % 26 + 65))


def suffix_number(text: Column) -> Column:
    """The n of suffix(n), without its hyphen; null for other texts."""
    first, last = F.ascii(F.substring(text, 1, 1)), F.ascii(F.substring(text, -1, 1))
    letter = lambda c: c.between(65, 90)
    first = first - F.when(first >= 0xE000, 0x800).otherwise(0)
    two = (F.length(text) == 2) & (first >= 65) & letter(last)
    return F.when((F.length(text) == 1) & letter(last), last - 65).when(two, 26 + (first - 65) * 26 + last - 65).cast("long")


def unique_skus(batch: DataFrame, library: DataFrame, order: str) -> DataFrame:
    """batch with new_sku: a model that the user's library or an earlier row of the batch has gets the next free suffix.

    The k-th row of a model that needs a suffix takes the k-th free one. With the used numbers sorted, u(j) - j free ones
    lie below the j-th used; so if used numbers by that and rows by k - 1 are put in one order, used ones first, a row's
    place in it is its number. Rows without a model are left out. A suffixed name that is itself a model of the batch
    counts as used.
    """
    key = ["user_id", "model"]
    b = batch.where(F.col("model") != "")
    taken = library.select("user_id", F.col("sku").alias("model")).distinct().withColumn("__taken", F.lit(True))
    b = b.join(taken, key, "left").withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - F.when(F.col("__taken"), 0).otherwise(1)).drop("__taken")
    used = library.select("user_id", F.col("sku").alias("name")).unionByName(b.select("user_id", F.col("model").alias("name"))).distinct()
    cut = lambda part: F.regexp_extract("name", "(?s)^(.*)-([^-]{1,2})$", part)
    used = used.select("user_id", cut(1).alias("model"), suffix_number(cut(2)).alias("__n")).where("model != '' and __n is not null")
    below = F.col("__n") - F.row_number().over(Window.partitionBy(*key).orderBy("__n")) + 1
    used = used.join(b.where("__k > 0").select(*key).distinct(), key, "left_semi").select(*key, below.alias("__at"), F.lit(0).alias("__kind"))
    rows = b.where("__k > 0").withColumns({"__at": F.col("__k").cast("long") - 1, "__kind": F.lit(1)})
    place = F.row_number().over(Window.partitionBy(*key).orderBy("__at", "__kind")).cast("long") - 1
    # the empty text makes model a new column: Spark 4.1 takes a union of two sides that are dealt alike to be so itself
    # (spark.sql.unionOutputPartitioning), but has their rows of one key in different tasks, and leaves out the exchange
    afresh = F.concat("model", F.lit(""))
    rows = rows.withColumn("model", afresh)
    named = rows.unionByName(used, allowMissingColumns=True).withColumn("__n", place).where("__kind = 1")
    named = named.withColumn("new_sku", F.concat("model", suffix(F.col("__n")))).drop("__at", "__kind", "__n", "__k")
    return b.where("__k = 0").drop("__k").withColumns({"new_sku": F.col("model"), "model": afresh}).unionByName(named)


def export_rows(df: DataFrame, user: str, columns: list[str], category: str | None = None, limit: int = 10_000) -> DataFrame:
    d = for_user(df, user)
    d = d.where(F.col("category") == category) if category else d
    return d.orderBy("id").limit(limit).select(*columns)


def export_columns(df: DataFrame, chosen: list[str], every: list[str], defaults: dict[str, str]) -> DataFrame:
    """Columns that aren't chosen are blank; chosen ones without a value get their default."""
    return df.select(*[c for c in df.columns if c not in every], *[(F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit(defaults.get(c, ""))) if c in chosen else F.lit("")).alias(c) for c in every])
