"""Words of many texts at once, for the functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def blocks(batches: Iterator[pd.DataFrame], text: str, limit: int, join: bool = False) -> Iterator[pd.DataFrame]:
    """The rows in pieces of about limit characters, null texts as empty ones. A longer text is a piece of its own.

    join: fill a piece from several batches, so that all but the last of a task are full.
    """
    held: list[pd.DataFrame] = []
    room = limit
    for pdf in batches:
        pdf = pdf.assign(**{text: pdf[text].fillna("")})
        size = pdf[text].str.len().to_numpy(dtype=np.int64)
        at, n = 0, len(pdf)
        while at < n:
            upto = at + max(int(np.searchsorted(np.cumsum(size[at:]), room, side="right")), 0 if held else 1)
            if upto > at:
                held.append(pdf.iloc[at:upto])
                room -= int(size[at:upto].sum())
            at = upto
            if held and (at < n or room <= 0):
                yield pd.concat(held, ignore_index=True)
                held, room = [], limit
        if held and not join:
            yield pd.concat(held, ignore_index=True)
            held, room = [], limit
    if held:
        yield pd.concat(held, ignore_index=True)


def split_words(texts: list[bytes], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, distinct): each word as a number, where each text begins (one more entry at the end), the words by number.

    bytes.split() cuts at the six ASCII white-space characters. end: a token to put after each text.
    """
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        words += t.split()
        if end is not None:
            words.append(end)
        starts[i + 1] = len(words)
    every = np.empty(len(words), dtype=object)
    every[:] = words
    codes, distinct = pd.factorize(every)
    return codes.astype(np.int64), starts, distinct


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values over each text; 0 for texts without any."""
    run = np.concatenate([np.zeros(1, dtype=np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    if values.dtype.kind != "f":
        return run[starts[1:]] - run[starts[:-1]]
    out = np.zeros(len(starts) - 1)
    some = starts[1:] > starts[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, starts[:-1][some])
    return out
