"""Words of many texts at once, as codes of a dictionary, without a Python object a word."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def joined(texts: Sequence[str | None], glue: bytes) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with ``glue`` (one separator byte) between them, and where each text begins. Null counts as empty."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return np.frombuffer(glue.join(parts), np.uint8), np.cumsum(lengths + 1) - lengths - 1


def spans(flat: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every longest stretch of bytes that are no separators."""
    is_word = np.ones(256, bool)
    is_word[np.frombuffer(separators, np.uint8)] = False
    inside = np.concatenate([[False], is_word[flat], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def coded(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for each span, and the different spans by code (binary)."""
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    inside = np.zeros(len(flat) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    letters = flat[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    array = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    found = array.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary
