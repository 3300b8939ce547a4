"""The best rows of each query, kept inside the tasks that score them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Queries that meet all rows at a time, and rows that a task scores at a time.
QUERY_BLOCK, SLICE = 1_024, 512
# Arrow's types of ids; Arrow finds those of others.
_ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def id_array(ids: list, kind: str) -> pa.Array:
    """Ids as a column of the Spark type ``kind``."""
    return pa.array(ids, _ARROW.get(kind))


class Leading:
    """What of a task's rows may be among the best ``k`` of a query. Rows come in slices, and in a slice in the order that breaks ties.

    Of each slice a query takes at most ``k`` rows, and none below the ``k``-th score seen so far; only those
    scores are held, so a task's memory does not depend on the number of its rows.
    """

    def __init__(self, k: int, queries: int) -> None:
        self.k, self.top = k, np.full((k, queries), -np.inf)

    def take(self, scores: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of the taken places of ``scores`` (rows by queries), all above ``floor``."""
        row, column = np.nonzero((scores >= self.top.min(axis=0)) & (scores > floor))
        order = np.lexsort((row, -scores[row, column], column))
        row, column = row[order], column[order]
        first = np.arange(len(column)) - np.searchsorted(column, column) < self.k
        self.top = np.partition(np.concatenate([self.top, scores]), -self.k, axis=0)[-self.k :]
        return row[first], column[first]
