"""Debouncing of events by path over ranges of time, so that one path's events are many tasks' work.

An event is handled if it comes at least `seconds` after the last handled one of its path. Which of a range's events are
handled hangs on the last one handled before it, but only through the first event that is free again: from there on each
handled event names the next one. So each range gives, for every event that may be the first free one, the last one handled
from there on; few of these differ, as walks from neighbouring events soon meet. Put together in order these steps give every range its
beginning, and each range is then walked by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .history import handled

C = F.col
#: Rows of a range, which one task holds.
RANGE_ROWS = 200_000
STEPS = "path string, no_path boolean, range int, upto array<bigint>, last array<bigint>"


def walks(times: np.ndarray, gap: int) -> np.ndarray:
    """For each of the sorted times the last one handled if it is."""
    following = np.searchsorted(times, times + gap)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    return times[last]


def steps(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, last): a walk that begins at an event up to upto[k], and after upto[k-1], ends at last[k]."""
    last = walks(times, gap)
    near = int(np.searchsorted(times, times[0] + gap)) + 1  # an earlier handled event blocks no longer than this
    last, times = last[:near], times[:near]
    ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
    return times[ends], last[ends]


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype(np.int64)


def debounce(events: DataFrame, path: str, ts: str, order: str, seconds: float, *, rows: int = RANGE_ROWS) -> DataFrame:
    """Events that are handled, in the columns of events. Of events of a path at one time the one with the smallest `order`,
    which must tell them apart, is the first. Events without a time are left out; those without a path are a path."""
    gap = round(seconds * 1_000_000)
    known = events.where(C(ts).isNotNull())
    ranges = max(-(-known.count() // rows), 1)
    r = staged(known.repartitionByRange(ranges, path, ts, order).withColumn("__range", F.spark_partition_id()), "debounce")
    columns = events.columns

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Steps of the range's first and last path, the only ones that other ranges may have a part of."""
        every = [None if pd.isna(p) else p for p in pdf[path].unique()]
        edge = {min(every, key=lambda p: (p is not None, p or "")), max(every, key=lambda p: (p is not None, p or ""))}
        found = []
        for name in edge:
            own = pdf.loc[pdf[path].isna() if name is None else pdf[path] == name, ts]
            found.append((name, name is None, int(key[0]), *(x.tolist() for x in steps(np.sort(micros(own)), gap))))
        return pd.DataFrame(found, columns=["path", "no_path", "range", "upto", "last"])

    def begun(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The last handled time before each range of a path: one short step a range."""
        last, found = None, []
        for at, upto, ends in pdf.sort_values("range")[["range", "upto", "last"]].itertuples(index=False):
            found.append((key[0], key[1], at, last))
            k = 0 if last is None else int(np.searchsorted(upto, last + gap))
            last = int(ends[k]) if k < len(upto) else last
        out = pd.DataFrame(found, columns=["path", "no_path", "range", "last"])
        return out.astype({"last": "Int64"})

    step = r.select(path, ts, "__range").groupBy("__range").applyInPandas(summed, STEPS)
    start = step.groupBy("path", "no_path").applyInPandas(begun, "path string, no_path boolean, range int, last long").where("last is not null")

    def walk(key: tuple, pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        free = {None if none else p: int(t) + gap for p, none, t in starts[["path", "no_path", "last"]].itertuples(index=False)}
        pdf = pdf.sort_values([ts, order], kind="stable")
        names = (None if pd.isna(p) else p for p in pdf[path])
        return pdf.iloc[handled(names, micros(pdf[ts]).tolist(), gap, free)][columns]

    return r.groupBy("__range").cogroup(start.groupBy("range")).applyInPandas(walk, events.schema)
