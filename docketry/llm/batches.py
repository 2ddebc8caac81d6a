"""Arrow batches cut so that a task's memory is bounded by bytes, not by rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketry.batches import SLICE_BYTES, give_back, slices

__all__ = ["SLICE_BYTES", "as_texts", "gather", "give_back", "slices"]


def as_texts(values: pa.Array) -> pa.Array:
    """A string array of one chunk without nulls: null text is empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(pc.cast(values, pa.string()), "")


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all runs `starts[i] .. starts[i] + lengths[i]`, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
