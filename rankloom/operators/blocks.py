"""What the stored indexes share in numpy and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def ragged(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the values of a list array, whatever slice it is."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest finite scores, ties to the smaller column."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero((scores >= kth) & np.isfinite(scores))
    else:
        rows, columns = np.nonzero(np.isfinite(scores))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[place < k], columns[place < k]
