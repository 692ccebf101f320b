import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orebed.functions import buffers, codecs, scalars
from orebed.functions import identity as ids


def test_u8_scale_table():
    for value, factor, want in ((101, 0.5, 50), (200, 2.0, 255), (200, -1.0, 0), (200, float("inf"), 255), (200, float("-inf"), 0), (200, float("nan"), 0)):
        assert buffers.scale_bytes(np.array([value], np.uint8), factor)[0] == want


@settings(max_examples=500, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.integers(1, 2**63 - 1))
def test_fraction_to_f32_rounds_once(n, d):
    """Against a search among neighbouring floats with exact arithmetic."""
    x = Fraction(n, d)
    got = np.float32(scalars.fraction_to_f32(x))
    near = [got, np.nextafter(got, np.float32(np.inf)), np.nextafter(got, np.float32(-np.inf))]
    gap = [abs(Fraction(float(v)) - x) for v in near]
    assert gap[0] == min(gap)
    if gap.count(gap[0]) > 1:
        assert int(got.view(np.uint32)) % 2 == 0


def test_fraction_edges():
    assert scalars.canonical(scalars.make_fraction(2, 4)) == (1, 2) and scalars.canonical(scalars.make_fraction(0, 99)) == (0, 1)
    for bad in (0, -2):
        with pytest.raises(ValueError):
            scalars.make_fraction(1, bad)
    with pytest.raises(OverflowError):
        scalars.canonical(Fraction(2**63))
    half = Fraction(2**24 * 2 + 1, 2)  # between two floats
    assert scalars.fraction_to_f32(half) == float(2**24)


def test_identities_of_single_values():
    assert ids.raw_content(b"abc") != ids.content("bytes", b"abc") != ids.content("string", "abc")
    assert ids.recipe("00" * 32, [], ["11" * 32, "00" * 32, "11" * 32]) == ids.recipe("00" * 32, [], ["00" * 32, "11" * 32])
    assert ids.content("record", {"b": "00" * 32, "a": "11" * 32}) == ids.content("record", {"a": "11" * 32, "b": "00" * 32})
    assert ids.raw_content(b"abc", ids.Namespace("x", "y")) != ids.raw_content(b"abc")
    with pytest.raises(ValueError):
        ids.parse_identity("AB" * 32)


def test_layouts():
    assert buffers.layout_issue([3], 3, 3) is None and buffers.layout_issue([2, 2, 4], 9, 18) is None and buffers.layout_issue([0, 5], 5, 0) is None
    for shape, stride, size in (([], 0, 0), ([1] * 4, 1, 1), ([3], 4, 3), ([2, 4], 3, 6), ([2, 4], 4, 7), ([2**40, 2**40], 2**40, 0)):
        assert buffers.layout_issue(shape, stride, size)


def test_storage_encoding():
    raw = buffers.encode_storage([2, 3], 4, b"12345678")
    assert buffers.decode_storage(raw) == ([2, 3], 4, b"12345678")
    for bad in (raw[:-1], raw + b"x", b"zz" + raw, raw[: len(buffers.storage_magic("orebed"))], b""):
        with pytest.raises(ValueError):
            buffers.decode_storage(bad)


def test_ppm():
    shape, stride, data = codecs.ppm_decode(b"P3 # c\n2 1\n255\n100 50 20\n200 100 50 # end")
    assert (shape, stride, data) == ([1, 2, 4], 8, bytes([100, 50, 20, 255, 200, 100, 50, 255]))
    padded = data + b"pad!"
    assert codecs.ppm_encode(shape, 12, padded) == codecs.ppm_encode(shape, stride, data) == b"P3\n2 1\n255\n100 50 20 200 100 50\n"
    for bad in (b"P6\n1 1\n255\n0 0 0", b"P3\n1 1\n254\n0 0 0", b"P3\n0 1\n255\n", b"P3\n1 1\n255\n0 0", b"P3\n1 1\n255\n0 0 256", b"P3\n1 1\n255\n0 0 x", b"P3\n1", b""):
        with pytest.raises(ValueError):
            codecs.ppm_decode(bad)


def png(width, height, depth, colour, rows, extra=b"", interlace=0):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return codecs.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_round_trip_and_kinds():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (17, 9)):
        pixels = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
        shape, stride, data = buffers.dense(pixels)
        for level in (1, 6, 9):
            assert codecs.png_decode(codecs.png_encode(shape, stride, data, level)) == (shape, stride, data)
    gray = codecs.png_decode(png(3, 1, 1, 0, b"\0\xa0"))
    assert gray[2] == bytes([255, 255, 255, 255, 0, 0, 0, 255, 255, 255, 255, 255])

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", b"\x80")
    assert codecs.png_decode(png(2, 1, 8, 3, b"\0\0\1", palette))[2] == bytes([1, 2, 3, 128, 4, 5, 6, 255])
    deep = codecs.png_decode(png(1, 1, 16, 2, b"\0\x11\x22\x33\x44\x55\x66"))
    assert deep[2] == bytes([0x11, 0x33, 0x55, 255])
    for kind in range(5):  # every filter of a row decodes to its own definition
        row = bytes([kind]) + bytes(range(8)) + bytes([kind]) + bytes(range(8, 16))
        assert len(codecs.png_decode(png(2, 2, 8, 6, row))[2]) == 16
    small = np.arange(5 * 5, dtype=np.uint8).reshape(5, 5)
    raw = b""
    for x0, y0, dx, dy in [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]:
        for line in small[y0::dy, x0::dx]:
            if len(line):
                raw += b"\0" + line.tobytes()
    got = np.frombuffer(codecs.png_decode(png(5, 5, 8, 0, raw, interlace=1))[2], np.uint8).reshape(5, 5, 4)
    assert (got[:, :, 0] == small).all()
    for bad in (b"x", png(1, 1, 8, 6, b"\0\0\0\0\0")[:-6], png(1, 1, 8, 6, b"\0", chunk(b"acTL", b"\0" * 8)), png(1, 1, 8, 5, b"\0\0"), png(2, 2, 8, 6, b"\0")):
        with pytest.raises(ValueError):
            codecs.png_decode(bad)


def read_webp(data):
    """Reads the one form of VP8L stream that the encoder writes, bit by bit."""
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    bits, at = int.from_bytes(data[20:], "little"), 0

    def take(n):
        nonlocal at
        at += n
        return bits >> (at - n) & ((1 << n) - 1)

    assert take(8) == 0x2F
    width, height = take(14) + 1, take(14) + 1
    take(1)
    assert take(3) == 0 and take(3) == 0
    for symbols in (280, 256, 256, 256):
        assert take(1) == 0
        n = take(4) + 4
        lengths = {codecs.LENGTH_ORDER[i]: v for i in range(n) if (v := take(3))}
        assert lengths == {0: 1, 8: 1} and take(1) == 0
        assert [take(1) for _ in range(symbols)] == [1] * 256 + [0] * (symbols - 256)
    assert [take(1) for _ in range(4)] == [1, 0, 0, 0]
    out = np.zeros((height, width, 4), np.uint8)
    for y in range(height):
        for x in range(width):
            for c in (1, 0, 2, 3):
                out[y, x, c] = int(f"{take(8):08b}"[::-1], 2)
    return out


def test_webp():
    pixels = np.random.default_rng(1).integers(0, 256, (3, 4, 4), dtype=np.uint8)
    assert (read_webp(codecs.webp_encode(*buffers.dense(pixels), 100)) == pixels).all()
    rough = read_webp(codecs.webp_encode(*buffers.dense(pixels), 50))
    assert (rough[:, :, 3] == pixels[:, :, 3]).all() and np.abs(rough.astype(int) - pixels).max() <= 16
    for q in (-1, 101):
        with pytest.raises(ValueError):
            codecs.webp_encode(*buffers.dense(pixels), q)


def test_resize_nearest():
    pixels = np.arange(4 * 2 * 4, dtype=np.uint8).reshape(2, 4, 4)
    got = buffers.resized(pixels, 2, 3)
    assert got.shape == (3, 2, 4) and (got[1] == pixels[0][[0, 2]]).all() and (got[2] == pixels[1][[0, 2]]).all()
    for w, h in ((0, 1), (1, -1), (2**32, 1)):
        with pytest.raises(ValueError):
            buffers.resized(pixels, w, h)


def test_prefix_bounds():
    from orebed.operators.catalog import prefix_upper_bound as upper

    assert upper("ab") == "ac" and upper("a\U0010ffff") == "b" and upper("\U0010ffff") is None and upper("") is None
    assert upper("퟿") == "" and "a\U0010ffff" < upper("a")


def test_fraction_columns_equal_exact_arithmetic_at_the_edges(spark):
    import random
    from fractions import Fraction

    from pyspark.sql import functions as F

    rng = random.Random(3)
    edge = [0, 1, -1, 2**31 - 1, -(2**31), 2**31, 2**32 + 1, 2**62, -(2**63), 2**63 - 1, 6, -9]
    rows = [(rng.choice(edge), rng.choice([x for x in edge if x > 0])) for _ in range(80)] + [(None, 3), (3, None)]
    df = spark.createDataFrame(rows, "n long, d long").select("n", "d", scalars.fraction("n", "d").alias("f"))
    got = df.select("n", "d", "f", scalars.f32_from_fraction("f").alias("x")).collect()
    for r in got:
        if r.n is None or r.d is None:
            assert r.f is None and r.x is None
        else:
            f = Fraction(r.n, r.d)
            assert tuple(r.f) == (f.numerator, f.denominator) and r.x == scalars.fraction_to_f32(f)
    small = [(rng.randint(-(2**31) - 9, 2**31 + 9), rng.randint(1, 2**20), rng.choice([rng.randint(-50, 50), -(2**31) - 1]) or 1, rng.randint(1, 2**11)) for _ in range(200)]
    frame = spark.createDataFrame(small, "a long, b long, c long, d long").select("*", scalars.fraction("a", "b").alias("x"), scalars.fraction("c", "d").alias("y"))
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y}
    for r in frame.select("*", *[f("x", "y").alias(k) for k, f in scalars.FRACTION_ARITHMETIC.items()]).collect():
        for k, f in ops.items():
            want = f(Fraction(r.a, r.b), Fraction(r.c, r.d))
            assert tuple(r[k]) == (want.numerator, want.denominator)
    for bad in (scalars.fraction(F.lit(1), F.lit(0)), scalars.fraction_divide(scalars.fraction(F.lit(1), F.lit(1)), scalars.fraction(F.lit(0), F.lit(1)))):
        with pytest.raises(Exception, match="fraction"):
            spark.range(1).select(bad).collect()
