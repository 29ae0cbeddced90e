"""Integer vectors: which embeddings are whole, their scaled components, and compact bytes that are equal
exactly when the vectors are equal. Shared by the whitening and the exact search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: scaled components saturate here, so that every finite entry has an integer
FAR = float(1 << 62)
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def pack(v: np.ndarray) -> list[bytes]:
    """Rows of an int64 matrix as bytes: the width of the narrowest integer that holds the row, then its values."""
    lo, hi = v.min(axis=1), v.max(axis=1)
    width = np.zeros(len(v), dtype=np.uint8)
    for w, kind in enumerate(_KINDS[:-1]):
        width[(lo < np.iinfo(kind).min) | (hi > np.iinfo(kind).max)] = w + 1
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(v[rows].astype(_KINDS[w])).view(np.uint8)
        raw = np.concatenate([np.full((len(rows), 1), w, dtype=np.uint8), raw], axis=1)
        for r, b in zip(rows.tolist(), raw):
            out[r] = b.tobytes()
    return out


def unpack(cells: list[bytes], dims: int) -> np.ndarray:
    """The int64 matrix of packed rows that all have ``dims`` values."""
    out = np.empty((len(cells), dims), dtype=np.int64)
    width = np.array([c[0] for c in cells], dtype=np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw = np.frombuffer(b"".join(cells[r][1:] for r in rows), dtype=_KINDS[w])
        out[rows] = raw.reshape(len(rows), dims)
    return out


def whole_rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat doubles, offsets, mask of the rows that are not null, not empty and hold finite entries only) of an Arrow
    list column of doubles."""
    n = len(column)
    length = np.zeros(n, dtype=np.int64)
    there = np.ones(n, dtype=bool)
    if n:
        there = ~np.asarray(column.is_null())
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry reads as NaN
    off = np.concatenate([[0], np.cumsum(length)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, off, there & (length > 0) & (bad[off[1:]] == bad[off[:-1]])


def scaled(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(np.clip(flat * scale, -FAR, FAR)).astype(np.int64)


def _pack_batches(scale: float):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            flat, off, ok = whole_rows(batch.column(1))
            dims = np.diff(off)
            for d in np.unique(dims[ok]):
                rows = np.flatnonzero(ok & (dims == d))
                step = max(1, (1 << 20) // int(d))
                for i in range(0, len(rows), step):
                    r = rows[i:i + step]
                    v = scaled(flat[off[r][:, None] + np.arange(d)[None, :]], scale)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(np.full(len(r), d, dtype=np.int32)),
                                                      pa.array(pack(v), type=pa.binary())], names=["id", "dims", "x"])
    return run


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(id long, dims int, x binary): floor(scale * entry) of every row whose vector is whole, packed."""
    return df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")) \
        .mapInArrow(_pack_batches(scale), "id long, dims int, x binary")


def matrices(batch, id_column: str = "id", dims_column: str = "dims", x_column: str = "x", most: int = 1 << 20):
    """Slices (rows, dims, int64 matrix) of a batch of packed vectors, at most ``most`` entries or one row each."""
    dims = np.asarray(batch.column(dims_column))
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        step = max(1, most // int(d))
        for i in range(0, len(rows), step):
            r = rows[i:i + step]
            import pyarrow as pa
            yield r, int(d), unpack(batch.column(x_column).take(pa.array(r)).to_pylist(), int(d))
