"""Price changes against the library, usage events, quote views, subscriptions; batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import product_key
from ..functions.prices import rounded

C = F.col


def rows() -> Column:
    return F.count(F.lit(1))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("product_key", product_key(C("model"), C("spec_zh")))


def latest(library: DataFrame) -> DataFrame:
    """One row per key, the last by idx."""
    return library.groupBy("product_key").agg(F.max_by(F.struct(C("price_rmb").alias("old_price"), "last_updated"), "idx").alias("x")).select(C("product_key").alias("key"), "x.old_price", "x.last_updated")


def library_change(new: DataFrame, library: DataFrame) -> DataFrame:
    """New rows with is_new, price_changed and the old price."""
    j = new.join(library, C("product_key") == C("key"), "left")
    known = C("key").isNotNull()
    return j.withColumns({"is_new": ~known, "price_changed": known & ~C("old_price").eqNullSafe(C("price_rmb"))})


def history_columns(new: DataFrame, library: DataFrame, as_of: str) -> DataFrame:
    """Last price, change in per cent and days since the last update."""
    j = new.join(library, C("product_key") == C("key"), "left")
    last = F.nullif(C("old_price"), F.lit(0.0))
    change = F.when(C("price_rmb") != 0, rounded((C("price_rmb") - last) / last * 100, 1))
    return j.withColumns({"last_price": last, "price_change": change, "days_since_update": F.datediff(F.lit(as_of).cast("date"), C("last_updated").try_cast("date"))})


def append_history(library: DataFrame, new: DataFrame) -> DataFrame:
    """Library with (date, old price) appended to the history of keys that new rows match, and their new price."""
    got = new.groupBy("product_key").agg(F.max_by("price_rmb", "idx").alias("new_price"))
    j = library.join(got, C("key") == C("product_key"), "left")
    entry = F.struct(C("last_updated").alias("date"), C("old_price").alias("price"))
    history = F.coalesce(C("history"), F.array().cast("array<struct<date:string,price:double>>"))
    return j.withColumn("history", F.when(C("product_key").isNotNull() & (F.coalesce("old_price", F.lit(0.0)) != 0), F.array_append(history, entry)).otherwise(history)).withColumn("price", F.coalesce("new_price", "old_price"))


def event_stats(events: DataFrame, days: int, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, per event, per day) of the last days before as_of."""
    at = F.lit(as_of).cast("timestamp")
    e = events.where((C("created_at") >= at - F.make_dt_interval(F.lit(days))) & (C("created_at") <= at))
    totals = e.agg(rows().alias("total"), F.countDistinct(F.nullif(C("session_id"), F.lit(""))).alias("sessions"))
    return totals, e.groupBy("event").agg(rows().alias("n")), e.groupBy(F.to_date("created_at").alias("day")).agg(rows().alias("n"))


def list_quotes(quotes: DataFrame, state: str, now: float) -> DataFrame:
    live = C("expires_at").isNull() | (C("expires_at") > now)
    d = quotes if state == "all" else quotes.where(live if state == "active" else ~live)
    return d.orderBy(F.desc("created_at"), "id")


def expires(created: Column, days: Column) -> Column:
    return created + days * 86400


def quote_views(views: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per quote the views with its key: number, last one, and the history in order."""
    v = views.join(quotes.select(C("id").alias("qid"), C("access_key").alias("k")), (C("quote_id") == C("qid")) & (C("access_key") == C("k")))
    return v.groupBy("quote_id").agg(rows().alias("view_count"), F.max("ts").alias("last_viewed"), F.array_sort(F.collect_list(F.struct("ts", "email"))).alias("history"))


def tier_of(kind: Column) -> Column:
    return F.when(kind.isin("checkout.completed", "subscription.active"), "pro").when(kind.isin("subscription.canceled", "subscription.past_due", "subscription.expired"), "free")


def subscription_state(events: DataFrame) -> DataFrame:
    """Per user the tier of the last event that sets one."""
    e = events.where(C("user_id") != "").withColumn("tier", tier_of(C("type"))).where("tier is not null")
    return e.groupBy("user_id").agg(F.max_by("tier", F.struct("ts", "id")).alias("tier"))


def valid_file(path: Column, endings=(".xlsx", ".xls", ".docx")) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def handled(paths, times, gap: int, free: dict) -> list[int]:
    """Places of the events, given in order of time, that are handled: a path's first, then always the next one at least gap
    after its last handled. free: by path the time from which it may be handled again, which is carried on."""
    out = []
    for at, (path, time) in enumerate(zip(paths, times, strict=True)):
        if time >= free.get(path, time):
            out.append(at)
            free[path] = time + gap
    return out


def first_of_path(events: DataFrame, path: str, ts: str, order: str) -> DataFrame:
    """Each path once, at its first event."""
    return events.groupBy(path).agg(F.min(F.struct(ts, order)).alias("x")).select(path, f"x.{ts}", f"x.{order}")


def flat_library(json_dict: DataFrame) -> DataFrame:
    """A library stored as one JSON object per line, key to product, as rows. json_dict: value."""
    return json_dict.select(F.explode(F.from_json("value", "map<string,struct<model:string,price:double,last_updated:string>>")).alias("product_key", "p")).select("product_key", "p.*")


def last_n(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(C("__rn") <= n).drop("__rn")
