"""Helpers for Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_of(batch: pa.RecordBatch, row: str | None = None, column: str = "text") -> pa.Array:
    """The text column of a batch, or of the struct column ``row``."""
    return batch.column(column) if row is None else pc.struct_field(batch.column(row), column)


def text_slices(batches: Iterable[pa.RecordBatch], row: str | None = None, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Row slices with their texts; a slice holds ``max_bytes`` of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = text_of(batch, row)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo, base = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist()
            lo, base = hi, int(size[hi - 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length - 1`` of every run, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    if not total:
        return out
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)
