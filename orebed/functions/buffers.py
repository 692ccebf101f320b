"""Shaped byte buffers: layout, fill, zero, byte maps, resizing and storage encoding.

A buffer is struct<shape array<bigint>, outer_stride bigint, data binary>. Padding bytes
between slices of the first dimension are data: they are mapped, filled and hashed.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars

BUFFER = T.StructType([T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("outer_stride", T.LongType()), T.StructField("data", T.BinaryType())])
ARROW_BUFFER = pa.struct([("shape", pa.list_(pa.int64())), ("outer_stride", pa.int64()), ("data", pa.binary())])
#: Fixed values of the storage encoding: a magic, then rank, dimensions, stride, length, bytes.
STORAGE_SUFFIX = b"-BUFFER\0\x01"
MAX_ARGUMENT, MAX_RESULT = 32 << 20, 64 << 20


def layout_issue(shape: list[int], stride: int, length: int) -> str | None:
    """Why a layout is invalid, or None."""
    if not 1 <= len(shape) <= 3:
        return "buffer rank must be one through three"
    if any(d < 0 for d in shape) or stride < 0:
        return "buffer dimensions must not be negative"
    if len(shape) == 1:
        return None if stride == shape[0] == length else "a rank-one buffer's stride and length must equal its dimension"
    inner, total = math.prod(shape[1:]), shape[0] * stride
    if max(inner, total) >= 1 << 64:
        return "buffer layout overflows"
    if stride < inner:
        return "buffer stride is shorter than one slice"
    return None if total == length else "buffer length must equal its first dimension times its stride"


def valid_layout(b: Column) -> Column:
    """The same rule as a Column; products in decimal(38, 0) so they cannot overflow."""
    shape, stride, length = b.getField("shape"), b.getField("outer_stride"), F.octet_length(b.getField("data"))
    wide = lambda x: x.cast("decimal(19,0)")
    rank = F.size(shape)
    inner = F.when(rank == 3, wide(F.get(shape, 1)) * wide(F.get(shape, 2))).otherwise(wide(F.get(shape, 1)).cast("decimal(38,0)"))
    some = F.forall(shape, lambda d: d >= 0) & (stride >= 0)
    flat = (stride == F.get(shape, 0)) & (stride == length)
    deep = (wide(stride) >= inner) & (wide(F.get(shape, 0)) * wide(stride) == length)
    return F.coalesce((rank >= 1) & (rank <= 3) & some & F.when(rank == 1, flat).otherwise(deep), F.lit(False))


def make(shape: Column, stride: Column, data: Column) -> Column:
    return F.struct(shape.cast("array<bigint>").alias("shape"), stride.cast("bigint").alias("outer_stride"), data.alias("data"))


def checked(b: Column) -> Column:
    return scalars.guard(valid_layout(b), b, "invalid buffer layout")


def _with_data(b: Column, data: Column) -> Column:
    return F.struct(b.getField("shape").alias("shape"), b.getField("outer_stride").alias("outer_stride"), data.alias("data"))


def fill(b: Column, value: Column | int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    byte = F.lpad(F.hex(scalars.u8_checked(value).cast("bigint")), 2, "0")
    return _with_data(b, F.unhex(F.repeat(byte, F.octet_length(b.getField("data")))))


def zero(b: Column) -> Column:
    return fill(b, 0)


def byte_map(b: Column, f: Callable[..., np.ndarray], *scalar_args: Column) -> Column:
    """Every storage byte replaced by f(bytes as uint8, offsets as int64, *scalars), row by row in numpy."""

    def run(data: pd.Series, *args: pd.Series) -> pd.Series:
        out = []
        for i, raw in enumerate(data):
            if raw is None:
                out.append(None)
                continue
            values = np.frombuffer(raw, np.uint8)
            got = f(values, np.arange(len(values), dtype=np.int64), *(a.iloc[i] for a in args))
            out.append(np.broadcast_to(got, values.shape).astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    return _with_data(b, F.pandas_udf(run, T.BinaryType())(b.getField("data"), *scalar_args))


def scale_bytes(values: np.ndarray, factor: float) -> np.ndarray:
    """u8.scale over an array."""
    with np.errstate(all="ignore"):
        x = values.astype(np.float32) * np.float32(factor)
        return np.where(np.isnan(x), np.float32(0), np.clip(x, 0, 255)).astype(np.uint8)


def rgba(shape: list[int], stride: int, data: bytes) -> np.ndarray:
    """Pixels of a rank-3 RGBA buffer, without padding."""
    issue = layout_issue(list(shape), stride, len(data))
    if issue:
        raise ValueError(issue)
    if len(shape) != 3 or shape[2] != 4 or not shape[0] or not shape[1]:
        raise ValueError("RGBA8 needs the shape [height, width, 4] with positive sides")
    return np.frombuffer(data, np.uint8).reshape(shape[0], stride)[:, : shape[1] * 4].reshape(shape[0], shape[1], 4)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    if not (1 <= width < 1 << 32 and 1 <= height < 1 << 32):
        raise ValueError("resize dimensions must be positive and below 2**32")
    if width * height * 4 > MAX_RESULT:
        raise ValueError("resized buffer exceeds the result limit")
    h, w, _ = pixels.shape
    return pixels[np.arange(height) * h // height][:, np.arange(width) * w // width]


def dense(pixels: np.ndarray) -> tuple[list[int], int, bytes]:
    return list(pixels.shape), pixels.shape[1] * 4, np.ascontiguousarray(pixels).tobytes()


def arrow_buffers(rows: list[tuple[list[int], int, bytes] | None]) -> pa.Array:
    return pa.array([None if r is None else dict(zip(("shape", "outer_stride", "data"), r, strict=True)) for r in rows], ARROW_BUFFER)


@F.arrow_udf(BUFFER)
def resize_nearest(b: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """The pixel at floor(place * source size / target size); exact, padding ignored, dense result. Null for null."""
    rows = zip(b.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True)
    return arrow_buffers([None if None in (x, w, h) else dense(resized(rgba(x["shape"], x["outer_stride"], x["data"]), w, h)) for x, w, h in rows])


def storage_magic(host: str) -> bytes:
    return host.upper().replace(".", "-").encode() + STORAGE_SUFFIX


def encode_storage(shape: list[int], stride: int, data: bytes, host: str = "orebed") -> bytes:
    return storage_magic(host) + bytes([len(shape)]) + struct.pack(f"<{len(shape)}QQQ", *shape, stride, len(data)) + data


def decode_storage(raw: bytes, host: str = "orebed") -> tuple[list[int], int, bytes]:
    """Inverse of encode_storage; wrong magic, rank, truncation and trailing bytes are errors."""
    magic = storage_magic(host)
    if not raw.startswith(magic) or len(raw) <= len(magic):
        raise ValueError("not a stored buffer")
    rank, at = raw[len(magic)], len(magic) + 1
    if not 1 <= rank <= 3 or len(raw) < at + 8 * (rank + 2):
        raise ValueError("truncated or invalid stored buffer")
    *shape, stride, length = struct.unpack_from(f"<{rank}QQQ", raw, at)
    data = raw[at + 8 * (rank + 2) :]
    if len(data) != length:
        raise ValueError("stored buffer has a wrong length")
    issue = layout_issue(shape, stride, length)
    if issue:
        raise ValueError(issue)
    return shape, stride, data


def encode_storage_column(b: Column, host: str = "orebed") -> Column:
    from .identity import fixed, le

    shape = b.getField("shape")
    dims = F.unhex(F.array_join(F.transform(shape, lambda d: F.hex(le(d))), ""))
    return F.concat(fixed(storage_magic(host)), le(F.size(shape), 1), dims, le(b.getField("outer_stride")), le(F.octet_length(b.getField("data"))), b.getField("data"))


def decode_storage_column(raw: Column, host: str = "orebed") -> Column:
    @F.arrow_udf(BUFFER)
    def run(values: pa.Array) -> pa.Array:
        return arrow_buffers([None if v is None else decode_storage(v, host) for v in values.to_pylist()])

    return run(raw)
