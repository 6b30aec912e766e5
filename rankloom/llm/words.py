"""Words of many texts at once, in numpy and Arrow: runs of bytes of one kind, with their texts' bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LETTER_CASE = np.arange(256, dtype=np.uint8)
LETTER_CASE[65:91] += 32
#: Bytes of words: all but a space and the controls from tab to carriage return.
INKED = np.ones(256, bool)
INKED[[32, *range(9, 14)]] = False
#: Bytes of terms: digits, A-Z, a-z and whatever is beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def cut(texts: pa.Array, of: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All runs of bytes in `of`, one after the other, and where each text's begin (one more at the end). Null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = of[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(flat)]
    begins[edges] = inside[edges]  # texts follow each other without a gap
    starts = np.flatnonzero(begins)
    kept = flat[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LETTER_CASE[kept] if lower else kept)])
    return words, np.searchsorted(starts, at)


def hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word (the halves of XXH3-128)."""
    coded = words.dictionary_encode()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()]), ">u8").astype(np.uint64).reshape(-1, 2)
    place = coded.indices.to_numpy()
    return both[place, 0], both[place, 1]
