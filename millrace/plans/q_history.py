"""Library history, quotes' states, usage events, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources import files
from ..sources.staging import shared_folder
from .registry import query

C = F.col
AS_OF = "2024-01-31 00:00:00"
_KEY = "substr(md5(concat_ws('|', nullif(trim(model), ''), nullif(trim(spec_zh), ''))), 1, 12)"
_LIB = f"nw AS (SELECT *, {_KEY} AS product_key FROM products_raw), lb AS (SELECT product_key AS key, arg_max(row(price_rmb), idx) AS p, arg_max(last_updated, idx) AS last_updated FROM (SELECT *, {_KEY} AS product_key FROM stored) GROUP BY 1), lj AS (SELECT nw.*, lb.key, lb.p[1] AS old_price, lb.last_updated FROM nw LEFT JOIN lb ON lb.key = nw.product_key)".replace("lb.p[1]", "struct_extract(lb.p, 1)")


def both(p, s):
    return H.keyed(p), H.latest(H.keyed(s))


@query("library_change", "products_raw", "stored", sql=_LIB + " SELECT idx, product_key, key IS NULL AS is_new, key IS NOT NULL AND old_price IS DISTINCT FROM price_rmb AS price_changed, round(old_price, 4) AS old_price FROM lj")
def library_change(p, s):
    return H.library_change(*both(p, s)).select("idx", "product_key", "is_new", "price_changed", F.round("old_price", 4).alias("old_price"))


@query("library_history_cols", "products_raw", "stored", sql=_LIB + " SELECT idx, round(nullif(old_price, 0), 4) AS last_price, CASE WHEN price_rmb <> 0 THEN round((price_rmb - nullif(old_price, 0)) / nullif(old_price, 0) * 100 + sign(price_rmb - nullif(old_price, 0)) * 1e-9, 1) END AS price_change, date_diff('day', CAST(last_updated AS DATE), DATE '2024-01-31') AS days_since_update FROM lj")
def library_history_cols(p, s):
    return H.history_columns(*both(p, s), AS_OF).select("idx", F.round("last_price", 4).alias("last_price"), "price_change", "days_since_update")


@query("price_history_append", "products_raw", "stored", sql=_LIB + """, g AS (SELECT product_key, arg_max(row(price_rmb), idx) AS np FROM nw GROUP BY 1)
SELECT key, CASE WHEN g.product_key IS NOT NULL AND coalesce(struct_extract(lb.p, 1), 0) <> 0 THEN 1 ELSE 0 END AS entries, CASE WHEN g.product_key IS NOT NULL AND coalesce(struct_extract(lb.p, 1), 0) <> 0 THEN last_updated END AS last_date, round(coalesce(struct_extract(np, 1), struct_extract(lb.p, 1)), 4) AS price FROM lb LEFT JOIN g ON g.product_key = lb.key""")  # fmt: skip
def price_history_append(p, s):
    new, library = both(p, s)
    out = H.append_history(library.withColumn("history", F.lit(None).cast("array<struct<date:string,price:double>>")), new)
    return out.select("key", F.size("history").alias("entries"), F.try_element_at("history", F.lit(-1))["date"].alias("last_date"), F.round("price", 4).alias("price"))


@query("json_library_io", "products_raw", sql=f"SELECT {_KEY} || '/' || idx AS product_key, model, price_rmb AS price FROM products_raw")
def json_library_io(p):
    """The library written as JSON objects of 500 entries to the shared folder and read back in parts."""
    key = F.concat("product_key", F.lit("/"), C("idx").cast("string"))  # keys of a library differ
    lib = H.keyed(p).select(key.alias("product_key"), "model", C("price_rmb").alias("price"), C("created_at").alias("last_updated"))
    folder = shared_folder(p.sparkSession, "library")
    files.write_json_objects(lib, folder, "product_key", rows=500)
    return files.read_json_objects(p.sparkSession, folder).select("product_key", "model", "price")


_EV = "ev AS (SELECT * FROM events_v WHERE created_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00')"


@query("event_stats", "events_v", sql=_EV + " SELECT 'event' AS what, event AS name, count(*) AS n FROM ev GROUP BY 2 UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM ev UNION ALL SELECT 'sessions', '', count(DISTINCT nullif(session_id, '')) FROM ev")
def event_stats(e):
    totals, kinds, days = H.event_stats(e, 7, AS_OF)
    row = lambda d, what, name, n: d.select(F.lit(what).alias("what"), name.alias("name"), C(n).alias("n"))
    return row(kinds, "event", C("event"), "n").unionByName(row(days, "day", C("day").cast("string"), "n")).unionByName(row(totals, "total", F.lit(""), "total")).unionByName(row(totals, "sessions", F.lit(""), "sessions"))


@query("list_quotes", "quotes", sql="SELECT id, CASE WHEN expires_at IS NULL OR expires_at > 1704500000 THEN 'active' ELSE 'expired' END AS state FROM quotes")
def list_quotes(q):
    now = 1704500000.0
    return H.list_quotes(q, "active", now).select("id", F.lit("active").alias("state")).unionByName(H.list_quotes(q, "expired", now).select("id", F.lit("expired").alias("state")))


@query("quote_expiry", "quotes", sql="SELECT id, created_at + (id % 9) * 86400.0::DOUBLE AS expires_at FROM quotes")
def quote_expiry(q):
    return q.select("id", H.expires(C("created_at"), (C("id") % 9).cast("double")).alias("expires_at"))


@query("quote_status", "quotes", "quote_views", sql="SELECT DISTINCT q.id, q.file_name, q.expires_at FROM quotes q JOIN quote_views v ON v.quote_id = q.id AND v.access_key = q.access_key")
def quote_status(q, v):
    """Status rows of the quotes that were asked for with their key."""
    asked = v.select("quote_id", C("access_key").alias("k")).distinct()
    return q.join(asked, (C("id") == C("quote_id")) & (C("access_key") == C("k")), "left_semi").select("id", "file_name", "expires_at")


@query("stream_quote_views_batch", "quote_views", "quotes", sql="SELECT quote_id, count(*) AS view_count, max(ts) AS last_viewed, len(list(email)) AS n_history FROM quote_views v JOIN quotes q ON q.id = v.quote_id AND q.access_key = v.access_key GROUP BY 1")
def stream_quote_views_batch(v, q):
    return H.quote_views(v, q).select("quote_id", "view_count", "last_viewed", F.size("history").alias("n_history"))


@query("newest_quotes", "quotes", sql="SELECT user_id, id FROM quotes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 3")
def newest_quotes(q):
    """The three newest quotations of each user."""
    return H.last_n(q, ["user_id"], [F.desc("created_at"), C("id")], 3).select("user_id", "id")
