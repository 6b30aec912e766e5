"""Columns of whole numbers as compact binaries, for rows that hold many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges that start at `starts` and have `sizes` places, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as four planes of bytes, low ones first: planes of small numbers compress to little."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 to 2**32 - 1, of any lengths."""
    head = np.array([len(c) for c in columns], "<u4").tobytes()
    return len(head).to_bytes(2, "little") + head + pa.compress(b"".join(map(_planes, columns)), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    head = int.from_bytes(data[:2], "little")
    sizes = np.frombuffer(data, "<u4", head // 4, 2)
    raw = np.frombuffer(pa.decompress(data[2 + head :], int(sizes.sum()) * 4, codec="zstd", asbytes=True), np.uint8)
    return [own.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64) for own in np.split(raw, np.cumsum(sizes.astype(np.int64))[:-1] * 4)]
