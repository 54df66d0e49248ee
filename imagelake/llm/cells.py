"""Pairs inside groups that come as sorted rows, for Arrow tasks: no group is gathered whole, and small ones cost little."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Rows = dict[str, np.ndarray]


def whole_cells(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], Rows], keys: tuple[str, ...], at_once: int = 4000) -> Iterator[Rows]:
    """Runs of rows that hold whole cells only. Rows come sorted by keys; a cell is whole when the next one begins."""
    kept: Rows | None = None
    for batch in batches:
        for begin in range(0, batch.num_rows, at_once):
            rows = arrays(batch.slice(begin, at_once))
            if kept:
                rows = {k: np.concatenate((kept[k], v)) for k, v in rows.items()}
            last = np.logical_and.reduce([rows[k] == rows[k][-1] for k in keys])
            start = int(np.argmax(last))
            kept = {k: v[start:] for k, v in rows.items()}
            if start:
                yield {k: v[:start] for k, v in rows.items()}
    if kept:
        yield kept


def pairs_of_cells(rows: Rows, keys: tuple[str, ...], limit: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs of each cell, at most about limit at once.

    A cell (i, j) pairs the rows whose own block is i with those whose own block is j; if i is j, each two rows once.
    """
    edge = np.ones(len(rows["own"]) + 1, bool)
    edge[1:-1] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    at = np.flatnonzero(edge)
    all_a, all_b, n = [], [], 0
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - begin < 2:
            continue
        i, j = rows["i"][begin], rows["j"][begin]
        if i == j:
            left = right = np.arange(begin, end)
        else:
            own = rows["own"][begin:end]
            left, right = begin + np.flatnonzero(own == i), begin + np.flatnonzero(own == j)
        step = max(1, limit // max(1, len(right)))
        for some in range(0, len(left), step):
            part = left[some : some + step]
            a, b = np.repeat(part, len(right)), np.tile(right, len(part))
            if i == j:
                a, b = a[a < b], b[a < b]
            all_a.append(a)
            all_b.append(b)
            n += len(a)
            if n >= limit:
                yield np.concatenate(all_a), np.concatenate(all_b)
                all_a, all_b, n = [], [], 0
    if n:
        yield np.concatenate(all_a), np.concatenate(all_b)
