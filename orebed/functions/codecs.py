"""Image codecs over RGBA buffers: PPM and PNG both ways, WebP encoding.

Each codec is a plain function on one value and an Arrow UDF over a column. WebP output is
lossless VP8L whose colours are quantised by the quality first: quality 100 keeps every
pixel. PNG bytes depend on zlib, so encoded files are compared by their pixels.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import BUFFER, MAX_ARGUMENT, MAX_RESULT, arrow_buffers, dense, rgba

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _limit(data: bytes) -> bytes:
    if len(data) > MAX_ARGUMENT:
        raise ValueError("argument exceeds the size limit")
    return data


# ---- PPM --------------------------------------------------------------------------------


def ppm_decode(data: bytes) -> tuple[list[int], int, bytes]:
    """ASCII P3 with maximum 255; comments run from # to the end of the line."""
    bare = re.sub(rb"#[^\n]*", b"", _limit(data))
    tokens = bare.split()
    if not tokens or tokens[0] != b"P3":
        raise ValueError("PPM must be ASCII P3")
    if not all(t.isdigit() and int(t) < 1 << 32 for t in tokens[1:]):
        raise ValueError("PPM holds an invalid number")
    if len(tokens) < 4:
        raise ValueError("PPM header is incomplete")
    width, height, top = map(int, tokens[1:4])
    if not width or not height:
        raise ValueError("PPM sides must be positive")
    if top != 255:
        raise ValueError("PPM maximum value must be 255")
    if len(tokens) - 4 != width * height * 3:
        raise ValueError("PPM has a wrong number of samples")
    samples = np.array(tokens[4:], dtype=np.int64)
    if samples.max() > 255:
        raise ValueError("PPM sample exceeds the maximum value")
    pixels = np.full((height, width, 4), 255, np.uint8)
    pixels[:, :, :3] = samples.reshape(height, width, 3)
    return dense(pixels)


def ppm_encode(shape: list[int], stride: int, data: bytes) -> bytes:
    pixels = rgba(shape, stride, _limit(data))
    height, width, _ = pixels.shape
    rows = [" ".join(map(str, row[:, :3].ravel().tolist())) for row in pixels]
    return f"P3\n{width} {height}\n255\n{chr(10).join(rows)}\n".encode()


# ---- PNG --------------------------------------------------------------------------------


def _unfilter(raw: bytes, width_bytes: int, rows: int, step: int) -> np.ndarray:
    out, at = np.zeros((rows, width_bytes), np.uint8), 0
    above = np.zeros(width_bytes, np.int32)
    for r in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, width_bytes, at + 1).astype(np.int32)
        at += width_bytes + 1
        if kind == 2:
            line = line + above & 255
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step]) & 255
        elif kind in (3, 4):
            values = line.tolist()
            up = above.tolist()
            for i in range(width_bytes):
                a, b, c = (values[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                values[i] = values[i] + guess & 255
            line = np.array(values, np.int32)
        elif kind:
            raise ValueError("PNG uses an unknown filter")
        out[r], above = line, line
    return out


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, : width * channels].reshape(len(rows), width, channels).astype(np.uint8)


def png_decode(data: bytes) -> tuple[list[int], int, bytes]:
    """Still PNG of any colour type, depth and interlace, as RGBA8. Animated PNG is an error."""
    if not _limit(data).startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    at, head, palette, alpha, packed = 8, None, None, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("PNG chunk is broken")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"acTL":
            raise ValueError("animated PNG is not supported")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    else:
        raise ValueError("PNG is truncated")
    if head is None or not packed:
        raise ValueError("PNG holds no image")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}[colour] or not width or not height:
        raise ValueError("PNG header is invalid")
    if width * height * 4 > MAX_RESULT:
        raise ValueError("PNG exceeds the result limit")
    raw = zlib.decompress(b"".join(packed))
    step = max(1, channels * depth // 8)
    #: First column, first row and steps of the seven interlace passes.
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlace else [(0, 0, 1, 1)]
    shape = (height, width, channels, 2) if depth == 16 else (height, width, channels)
    samples, pos = np.zeros(shape, np.uint8), 0
    for x0, y0, dx, dy in passes:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = (w * channels * depth + 7) // 8
        part = raw[pos : pos + h * (line + 1)]
        if len(part) != h * (line + 1):
            raise ValueError("PNG holds too few pixels")
        pos += len(part)
        samples[y0::dy, x0::dx] = _samples(_unfilter(part, line, h, step), w, channels, depth)
    out = np.full((height, width, 4), 255, np.uint8)
    key = np.frombuffer(alpha, ">u2") if alpha is not None and colour in (0, 2) else None
    exact = samples.astype(np.uint16) if depth != 16 else samples[..., 0].astype(np.uint16) << 8 | samples[..., 1]
    eight = samples if depth == 8 or colour == 3 else samples[..., 0] if depth == 16 else samples * (255 // ((1 << depth) - 1))
    if colour == 3:
        if palette is None or samples.max() >= len(palette):
            raise ValueError("PNG palette is missing or too short")
        out[:, :, :3] = palette[samples[:, :, 0]]
        clear = np.full(len(palette), 255, np.uint8)
        if alpha is not None:
            clear[: len(alpha)] = np.frombuffer(alpha, np.uint8)[: len(palette)]
        out[:, :, 3] = clear[samples[:, :, 0]]
    else:
        out[:, :, :3] = eight[:, :, :3] if channels >= 3 else eight[:, :, :1]
        if channels in (2, 4):
            out[:, :, 3] = eight[:, :, channels - 1]
        if key is not None:
            out[:, :, 3] = np.where((exact == key[:channels]).all(axis=2), 0, 255)
    return dense(out)


def png_encode(shape: list[int], stride: int, data: bytes, compression: int = 6) -> bytes:
    """RGBA8, Paeth filter on every row."""
    if not 1 <= compression <= 9:
        raise ValueError("PNG compression must be 1 through 9")
    pixels = rgba(shape, stride, _limit(data))
    height, width, _ = pixels.shape
    x = pixels.reshape(height, width * 4).astype(np.int32)
    a, b, c = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    a[:, 4:], b[1:], c[1:, 4:] = x[:, :-4], x[:-1], x[:-1, :-4]
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    rows = np.full((height, width * 4 + 1), 4, np.uint8)
    rows[:, 1:] = (x - guess) & 255

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), compression)) + chunk(b"IEND", b"")


# ---- WebP -------------------------------------------------------------------------------


class _Bits:
    def __init__(self) -> None:
        self.value, self.count = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.count
        self.count += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.count + 7) // 8, "little")


#: The order in which a VP8L stream lists the lengths of its code-length code.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _flat_code(bits: _Bits, symbols: int) -> None:
    """A prefix code of 256 symbols of 8 bits each; further symbols have none."""
    bits.put(0, 1)  # not a simple code
    used = {8: 1, 0: 1}
    last = max(LENGTH_ORDER.index(k) for k in used)
    bits.put(last + 1 - 4, 4)
    for k in LENGTH_ORDER[: last + 1]:
        bits.put(1 if k in used else 0, 3)
    bits.put(0, 1)  # lengths for all symbols follow
    # of two lengths with codes of one bit, the smaller (0) has code 0
    for s in range(symbols):
        bits.put(1 if s < 256 else 0, 1)


def webp_encode(shape: list[int], stride: int, data: bytes, quality: int = 85) -> bytes:
    """A RIFF/WEBP file with a lossless VP8L image of colours quantised by the quality."""
    if not 0 <= quality <= 100:
        raise ValueError("WebP quality must be 0 through 100")
    pixels = rgba(shape, stride, _limit(data))
    height, width, _ = pixels.shape
    if max(width, height) > 16383:
        raise ValueError("WebP sides must not exceed 16383")
    step = 1 + (100 - quality) * 31 // 100
    colours = pixels.astype(np.int32)
    if step > 1:
        colours[:, :, :3] = np.clip((colours[:, :, :3] + step // 2) // step * step, 0, 255)
    bits = _Bits()
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(int((colours[:, :, 3] != 255).any()), 1)
    bits.put(0, 3)  # version
    bits.put(0, 1)  # no transform
    bits.put(0, 1)  # no colour cache
    bits.put(0, 1)  # one group of prefix codes
    for symbols in (280, 256, 256, 256):  # green, red, blue, alpha
        _flat_code(bits, symbols)
    bits.put(1, 1)  # distance: a simple code of one symbol
    bits.put(0, 1)
    bits.put(0, 1)
    bits.put(0, 1)
    # codes of 8 bits are the symbols themselves, most significant bit first
    turned = np.array([int(f"{v:08b}"[::-1], 2) for v in range(256)], np.uint8)
    body = turned[colours[:, :, [1, 0, 2, 3]].astype(np.uint8)].tobytes()
    image = (bits.value | int.from_bytes(body, "little") << bits.count).to_bytes((bits.count + 8 * len(body) + 7) // 8, "little")
    image += b"\0" * (len(image) % 2)
    size = (bits.count + 8 * len(body) + 7) // 8
    return b"RIFF" + struct.pack("<I", 12 + len(image)) + b"WEBPVP8L" + struct.pack("<I", size) + image


# ---- columns ----------------------------------------------------------------------------


def _encoded(b: pa.Array, f, *settings: pa.Array) -> pa.Array:
    """f of every buffer and its settings; null where any of them is null."""
    rows = zip(b.to_pylist(), *(s.to_pylist() for s in settings), strict=True)
    return pa.array([None if None in (x, *more) else f(x["shape"], x["outer_stride"], x["data"], *more) for x, *more in rows], pa.binary())


@F.arrow_udf(BUFFER)
def ppm_decode_column(data: pa.Array) -> pa.Array:
    return arrow_buffers([None if d is None else ppm_decode(d) for d in data.to_pylist()])


@F.arrow_udf(T.BinaryType())
def ppm_encode_column(b: pa.Array) -> pa.Array:
    return _encoded(b, ppm_encode)


@F.arrow_udf(BUFFER)
def png_decode_column(data: pa.Array) -> pa.Array:
    return arrow_buffers([None if d is None else png_decode(d) for d in data.to_pylist()])


@F.arrow_udf(T.BinaryType())
def png_encode_column(b: pa.Array, compression: pa.Array) -> pa.Array:
    return _encoded(b, png_encode, compression)


@F.arrow_udf(T.BinaryType())
def webp_encode_column(b: pa.Array, quality: pa.Array) -> pa.Array:
    return _encoded(b, webp_encode, quality)
