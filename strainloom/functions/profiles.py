"""Allele profiles as NumPy matrices inside tasks: decoding and the missing-aware distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extent(profiles: DataFrame, alleles: str) -> tuple[int, int]:
    """(rows, loci): loci is the length of the longest profile, 0 for an empty table."""
    rows, loci = profiles.agg(F.count(F.lit(1)), F.max(F.size(alleles))).first()
    return rows, max(0, loci or 0)


def matrix(column: pa.ChunkedArray | pa.Array, loci: int) -> np.ndarray:
    """int16 matrix of an array<smallint> column; null arrays, null and non-positive values are 0 (missing), as are the
    loci after the end of a shorter array. A profile of more than `loci` values raises ValueError."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), loci), np.int16)
    if not len(column):
        return out
    flat = column.values.fill_null(0).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    lengths[np.asarray(column.is_null())] = 0
    if lengths.max() > loci:
        raise ValueError(f"a profile of {lengths.max()} loci where {loci} are expected")
    if (lengths == loci).all():
        out[:] = flat[offsets[0] : offsets[0] + loci * len(column)].reshape(-1, loci)
    else:
        rows = np.repeat(np.arange(len(column)), lengths)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, at] = flat[offsets[rows] + at]
    out[out < 0] = 0
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: among the loci above 0 in both, the share with different values; 1 if there are none."""
    both = (a > 0) & (b > 0)
    n = both.sum(1)
    return np.where(n > 0, ((a != b) & both).sum(1) / np.maximum(n, 1), 1.0)


def pack(rows: np.ndarray) -> pa.Array:
    """Rows as binary values: all low bytes, then the high bytes, two to a byte where all values are below 4,096."""
    n, loci = rows.shape
    if loci % 2:
        rows = np.concatenate([rows, np.zeros((n, 1), rows.dtype)], 1)
    low, high = (rows & 255).astype(np.uint8), (rows >> 8).astype(np.uint8)
    if n and rows.max() < 4096:
        high = high[:, ::2] | (high[:, 1::2] << 4)
    data = np.concatenate([low, high], 1)
    offsets = (np.arange(n + 1) * data.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def unpack(blobs: pa.ChunkedArray | pa.Array, loci: int) -> np.ndarray:
    """The rows that pack made."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    even = loci + loci % 2
    out = np.empty((len(blobs), even), np.int16)
    if len(blobs):
        offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
        data, widths = np.frombuffer(blobs.buffers()[2], np.uint8), np.diff(offsets)
        for width in (even + even // 2, 2 * even):
            which = np.flatnonzero(widths == width)
            if len(which):
                raw = data[offsets[which][:, None] + np.arange(width)]
                high = raw[:, even:].astype(np.int16)
                if width < 2 * even:
                    high = np.stack([high & 15, high >> 4], 2).reshape(len(raw), even)
                out[which] = raw[:, :even] | (high << 8)
    return out[:, :loci]
