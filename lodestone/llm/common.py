"""Shared helpers: files in the shared folder, and byte-level text access."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.scratch import cleared, dropped, filesystem, scope, scratch, shared_root, written

__all__ = ["cleared", "dropped", "filesystem", "scope", "scratch", "shared_root", "written"]

#: The white space that separates words, as characters.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def saved(path: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that a retried task never leaves half of one."""
    fs, at = filesystem(path)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def loaded(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        return f.read()


def made(path: str) -> None:
    """Create a folder of the shared file system."""
    fs, at = filesystem(path)
    fs.create_dir(at, recursive=True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A 64-bit column as unsigned integers; nulls become 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
