"""Lists that belong to a form and not to its data, and work on one page at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

#: Rows that a fixed list may have.
MOST_ROWS = 5_000


def fixed_rows(df: DataFrame) -> list[Row]:
    """All rows of a list that is fixed by design (labels, patterns, vocabularies). A table that outgrew that is an error."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a fixed list has at most {MOST_ROWS} rows")
    return rows


def page_by_page(df: DataFrame, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType | str, *keys: str) -> DataFrame:
    """The rows that `work(rows, page)` returns for runs of whole pages: page_num (and further keys) of each doc_id.

    A form has few regions on a page, and any call for one page costs more than its work. So rows come sorted by page, in
    Arrow batches cut where a page ends, and `page` numbers them from 0 in each run; the work is done on arrays of a
    run. Only a page larger than a batch makes a run grow.
    """
    by = ["doc_id", "page_num", *keys]

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        held: list[pd.DataFrame] = []
        for rows in frames:
            if not len(rows):
                continue
            last = held[-1].iloc[-1:] if held else rows.iloc[:1]
            starts = np.flatnonzero(np.diff(_page(pd.concat([last, rows], ignore_index=True), by)))
            if len(starts):
                run = pd.concat([*held, rows.iloc[: starts[-1]]], ignore_index=True)
                if len(run):
                    yield run, _page(run, by)
                held = []
            held.append(rows.iloc[starts[-1] :] if len(starts) else rows)
        if held:
            run = pd.concat(held, ignore_index=True)
            yield run, _page(run, by)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, page in runs(frames):
            yield work(rows, page)

    return df.repartition("doc_id", "page_num").sortWithinPartitions(*by).mapInPandas(batches, schema)


def _page(rows: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Numbers from 0 that rise where one of the keys changes; nulls are equal."""
    new = np.zeros(max(len(rows) - 1, 0), bool)
    for k in by:
        new |= np.diff(pd.factorize(rows[k])[0]) != 0
    return np.concatenate([[0], np.cumsum(new)])[: len(rows)]


#: Pairs that are in memory at once.
PAIRS = 1 << 20


def pairs(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with first[i] <= j < end[i], in order, by blocks of i with about PAIRS of them."""
    n = np.maximum(end - first, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        to = max(int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1, at + 1)
        m = n[at:to]
        j = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at] - first[at:to], m)
        yield np.repeat(np.arange(at, to), m), j
        at = to


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where boxes (x1, y1, x2, y2) of two lists share an area."""
    return (np.minimum(a[:, 2], b[:, 2]) > np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 3], b[:, 3]) > np.maximum(a[:, 1], b[:, 1]))
