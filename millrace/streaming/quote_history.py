"""Views of quotations in order of time, numbered by quotation, as a stream whose state ends with the quotation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.ordering import numbered_within

C = F.col
SCHEMA = "quote_id long, view_no long, at long, email string"
#: Timers need this store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: The expiry of quotations that have none.
NEVER = 2**63 - 1


def counted_views(views: DataFrame, quotes: DataFrame) -> DataFrame:
    """Views with a quotation's key before it expires, with the time of that (null: never). A view without a time counts nowhere."""
    keys = quotes.select(C("id").alias("qid"), C("access_key").alias("k"), F.timestamp_micros((C("expires_at") * 1_000_000).cast("long")).alias("expires"))
    v = views.join(keys, (C("quote_id") == C("qid")) & (C("access_key") == C("k")))
    return v.where(C("ts").isNotNull() & (C("expires").isNull() | (C("ts") < C("expires")))).select("quote_id", "id", "ts", "email", "expires")


def millis(micros: int) -> int:
    return -(-micros // 1000)


class ViewHistory(StatefulProcessor):
    """Holds views until no earlier one can come, then gives them out in order, each quotation's numbered on from its last.
    A key is a quotation or a bucket of some.

    State: the views still held; by quotation how many went out, and when it expires, at which its state goes. One timer, at
    the first held view's time or the first expiry. An id that comes again while it is held counts once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "quote_id array<long>, id array<long>, at array<long>, email array<string>")
        self.sent = handle.getValueState("sent", "quote_id array<long>, n array<long>, expires array<long>")

    @staticmethod
    def _rows(state) -> Iterator[tuple]:
        return zip(*state.get(), strict=True) if state.exists() else iter(())

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        """Columns as arrays: a list state takes a fraction of a millisecond a row."""
        state.update(tuple(map(list, zip(*rows, strict=True)))) if rows else state.clear()

    def _go_on(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        sent = {q: (n, expires) for q, n, expires in self._rows(self.sent)}
        held = {row[:2]: row for row in self._rows(self.held)}
        told: dict[int, int] = {}
        for q, i, at, email, expires in new:
            held.setdefault((q, i), (q, i, at, email))
            sent.setdefault(q, (0, NEVER))
            if expires != NEVER:
                told[q] = max(told.get(q, expires), expires)
        sent |= {q: (sent[q][0], expires) for q, expires in told.items()}
        passed, ready, rest = watermark * 1000, [], []
        for q, i, at, email in sorted(held.values(), key=lambda r: (r[2], r[1])):
            n, expires = sent[q]
            if at <= passed:
                sent[q] = (n + 1, expires)
                ready.append((q, n + 1, at, email))
            elif expires > passed:
                rest.append((q, i, at, email))
        live = [(q, n, expires) for q, (n, expires) in sent.items() if expires > passed]
        self._keep(self.held, rest)
        self._keep(self.sent, live)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        wake = min([at for _, _, at, _ in rest[:1]] + [expires for _, _, expires in live], default=NEVER)
        if wake != NEVER:
            self.handle.registerTimer(millis(wake))
        if ready:
            yield pd.DataFrame(ready, columns=["quote_id", "view_no", "at", "email"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [row for pdf in rows for row in zip(*(pdf[c].tolist() for c in ("quote_id", "id", "at", "email", "expires")), strict=True)]
        yield from self._go_on(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go_on([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def view_history(views: DataFrame, quotes: DataFrame, late: str = "2 days", buckets: int | None = None) -> DataFrame:
    """Stream of views (id, quote_id, access_key, email, ts) as quote_id, view_no, ts, email, each as soon as no earlier one can
    come: the watermark is `late` behind. quotes is a table (id, access_key, expires_at in seconds).

    buckets: state and calls are one a bucket of quotations, by their ids' hash, not one a quotation; for many quotations, as
    a call costs some milliseconds. A checkpoint holds for one number of buckets."""
    v = counted_views(views.withWatermark("ts", late), quotes)
    v = v.withColumns({"at": F.unix_micros("ts"), "expires": F.coalesce(F.unix_micros("expires"), F.lit(NEVER))})
    v = v.withColumn("bucket", F.pmod(F.xxhash64("quote_id"), F.lit(buckets)).cast("int")) if buckets else v
    out = v.groupBy("bucket" if buckets else "quote_id").transformWithStateInPandas(ViewHistory(), SCHEMA, "Append", "EventTime")
    return out.select("quote_id", "view_no", F.timestamp_micros("at").alias("ts"), "email")


def view_history_batch(views: DataFrame, quotes: DataFrame) -> DataFrame:
    """The same over a table; a quotation with many views spreads over tasks."""
    v = counted_views(views, quotes).dropDuplicates(["quote_id", "id"])
    return numbered_within(v, "quote_id", "ts", "id").select("quote_id", C("place").cast("long").alias("view_no"), "ts", "email")
