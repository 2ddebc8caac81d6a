"""Arrow batches cut so that a task's memory is bounded by bytes, not by rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


@lru_cache(1)
def _trimmer():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    """Freed memory goes back to the system. Workers live through many stages, and what one of
    them freed would otherwise stand beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text; a longer text is a range of its own. After
    the last one freed memory is given back."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop
    give_back()
