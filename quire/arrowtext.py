"""Arrow string columns as flat numpy code-point arrays, and back.

One decode and one encode call per record batch; no call per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _plain(arr: pa.Array) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    return arr


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, int64 offsets of length n+1 starting at 0). Nulls have length 0."""
    arr = _plain(arr)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if arr.null_count:
        # null slots may keep bytes: cut them out so that offsets stay dense
        valid = np.asarray(arr.is_valid())
        size = np.diff(off)
        if size[~valid].any():
            raw = raw[np.repeat(valid, size)]
        off = np.concatenate([[0], np.cumsum(np.where(valid, size, 0))])
    return raw, off


def codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 code points of all rows, int64 row offsets of length n+1)."""
    raw, off = byte_view(arr)
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(cp) == len(raw):  # pure ASCII
        return cp, off
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cp, lead[off]


def to_strings(cp: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of codepoints()."""
    cp = np.ascontiguousarray(cp, "<u4")
    data = cp.tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[off]
    bits = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    if at[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.string(), len(off) - 1, [bits, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [bits, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def owners(off: np.ndarray) -> np.ndarray:
    """The row of each element of a ragged array with these offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
