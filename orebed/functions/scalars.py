"""Scalar semantics as Columns: checked integers, binary32 floats, bytes, fractions.

Integers rely on ANSI mode, which raises on overflow and division by zero. Floats follow
IEEE 754, where Spark does not: its NaN equals itself and its division promotes and raises.
Guards are part of the value expression, since the optimiser drops unused columns.
"""

from __future__ import annotations

import math
import struct
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

I64_MIN, I64_MAX = -(2**63), 2**63 - 1
NAN, INF = float("nan"), float("inf")


def guard(ok: Column, value: Column, message: str) -> Column:
    """The value where ok holds; elsewhere the row fails with the message."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


# ---- i64 --------------------------------------------------------------------------------


def i64_binary(op: str, a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    if op == "/":
        return F.call_function("div", a, b)  # truncates; raises on 0 and on the least integer by -1
    return {"+": a + b, "-": a - b, "*": a * b}[op] if op in "+-*" else compare(op, a, b)


def compare(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


# ---- f32 --------------------------------------------------------------------------------


def _signbit(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def f32_divide(a: Column, b: Column) -> Column:
    """Binary32 division; the double quotient of two floats rounds once more to the right float."""
    nan, inf = F.lit(NAN).cast("float"), F.lit(INF).cast("float")
    zero = F.when(a == 0, nan).when(_signbit(a) != _signbit(b), -inf).otherwise(inf)
    quotient = (a.cast("double") / F.when(b == 0, F.lit(1.0)).otherwise(b.cast("double"))).cast("float")
    return F.when(F.isnan(a) | F.isnan(b), nan).when(b == 0, zero).otherwise(quotient)


def f32_binary(op: str, a: Column, b: Column) -> Column:
    a, b = a.cast("float"), b.cast("float")
    if op == "/":
        return f32_divide(a, b)
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    unordered = F.isnan(a) | F.isnan(b)
    return unordered | compare(op, a, b) if op == "!=" else ~unordered & compare(op, a, b)


def u8_checked(value: Column) -> Column:
    return guard(value.between(0, 255), value.cast("int"), "integer does not fit u8")


def u8_scale(value: Column, factor: Column) -> Column:
    """Binary32 product, truncated and saturated to 0..255; NaN gives 0."""
    x = value.cast("float") * factor.cast("float")
    return F.when(F.isnan(x) | (x <= 0), F.lit(0)).when(x >= 255, F.lit(255)).otherwise(x.cast("int"))


@F.arrow_udf(T.FloatType())
def f32_from_bits(bits: pa.Array) -> pa.Array:
    """The float with these bits; null for null."""
    given = bits.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if ((given < 0) | (given > 2**32 - 1)).any():
        raise ValueError("f32 bits must be in 0..=4294967295")
    return pa.array(given.astype(np.uint32).view(np.float32), mask=_nulls(bits))


@F.arrow_udf(T.LongType())
def f32_to_bits(value: pa.Array) -> pa.Array:
    plain = value.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float32)
    return pa.array(plain.view(np.uint32).astype(np.int64), mask=_nulls(value))


def _nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def float_literal(value: float) -> str:
    """The shortest plain decimal text that reads back as the same float; else its bits."""
    bits = struct.unpack("<I", struct.pack("<f", value))[0]
    if math.isfinite(value) and bits < 1 << 31:
        for digits in range(1, 150):
            text = f"{value:.{digits}f}"
            if struct.pack("<f", float(text)) == struct.pack("<f", value):
                return text
    return f"f32.from_bits({bits})"


# ---- fractions --------------------------------------------------------------------------

NO_DENOMINATOR, ZERO_DIVISOR = "a fraction needs a denominator above zero", "a fraction cannot be divided by zero"
FRACTION = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])


def canonical(value: Fraction) -> tuple[int, int]:
    if not (I64_MIN <= value.numerator <= I64_MAX and value.denominator <= I64_MAX):
        raise OverflowError("fraction does not fit its i64 range")
    return value.numerator, value.denominator


def make_fraction(num: int, den: int) -> Fraction:
    if den <= 0:
        raise ValueError(NO_DENOMINATOR)
    return Fraction(num, den)


def fraction_to_f32(value: Fraction) -> float:
    """Rounded once, to the nearest float with ties to even, by integer arithmetic."""
    n, d = abs(value.numerator), value.denominator
    if not n:
        return 0.0
    shift = 25 - (n.bit_length() - d.bit_length())  # quotient of 25 or 26 bits
    least = 149 + 1  # bits below the smallest subnormal, one for rounding
    shift = min(shift, least)
    scaled, rest = divmod(n << max(shift, 0), d << max(-shift, 0))
    extra = max(scaled.bit_length() - 24, 1 if shift == least else 0)
    keep, low = scaled >> extra, scaled & ((1 << extra) - 1)
    half = 1 << (extra - 1) if extra else 0
    if extra and (low > half or low == half and (rest or keep & 1)):
        keep += 1
    try:
        out = math.ldexp(keep, extra - shift)
        out = struct.unpack("<f", struct.pack("<f", out))[0]
    except OverflowError:
        out = INF
    return -out if value.numerator < 0 else out


SMALL = 1 << 31  # below it, products fit 64 bits and their sums too
EXACT = 1 << 24  # up to it, a quotient of doubles rounds to the nearest float


def _parts(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators, denominators (0/1 for null) and nulls of a fraction column."""
    num, den = column.field("num"), column.field("den")
    null = _nulls(column) | _nulls(num) | _nulls(den)
    return _whole(num, 0, null), _whole(den, 1, null), null


def _whole(column: pa.Array, instead: int, null: np.ndarray) -> np.ndarray:
    return np.where(null, instead, column.fill_null(instead).to_numpy(zero_copy_only=False)).astype(np.int64)


def _column(num: np.ndarray, den: np.ndarray, null: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(num), pa.array(den)], fields=[pa.field("num", pa.int64()), pa.field("den", pa.int64())], mask=pa.array(null))


def _checked(den: np.ndarray) -> None:
    if (den <= 0).any():
        raise ValueError(NO_DENOMINATOR)


def _reduced(num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In lowest terms with a positive denominator; neither part is the least of 64 bits."""
    g = np.gcd(num, den) * np.sign(den)
    return num // g, den // g


@F.arrow_udf(FRACTION)
def fraction(num: pa.Array, den: pa.Array) -> pa.Array:
    """num/den in lowest terms; null if either is null."""
    null = _nulls(num) | _nulls(den)
    n, d = _whole(num, 0, null), _whole(den, 1, null)
    _checked(d)
    least = n == I64_MIN
    top, low = _reduced(np.where(least, 0, n), d)
    for i in np.flatnonzero(least):
        top[i], low[i] = canonical(make_fraction(int(n[i]), int(d[i])))
    return _column(top, low, null)


def _arithmetic(name: str, vector, single):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (an, ad, a0), (bn, bd, b0) = _parts(a), _parts(b)
        null = a0 | b0
        _checked(np.where(null, 1, ad))
        _checked(np.where(null, 1, bd))
        if name == "fraction_divide":
            if (bn[~null] == 0).any():
                raise ZeroDivisionError(ZERO_DIVISOR)
            bn = np.where(null, 1, bn)
        fits = null | np.all([(-SMALL < x) & (x < SMALL) for x in (an, ad, bn, bd)], axis=0)
        num, den = _reduced(*vector(*(np.where(fits, x, 1) for x in (an, ad, bn, bd))))
        for i in np.flatnonzero(~fits):  # beyond 64 bits, by Python's integers
            num[i], den[i] = canonical(single(Fraction(int(an[i]), int(ad[i])), Fraction(int(bn[i]), int(bd[i]))))
        return _column(num, den, null)

    run.__name__ = name
    return F.arrow_udf(run, FRACTION)


fraction_add = _arithmetic("fraction_add", lambda n, d, m, e: (n * e + m * d, d * e), lambda x, y: x + y)
fraction_subtract = _arithmetic("fraction_subtract", lambda n, d, m, e: (n * e - m * d, d * e), lambda x, y: x - y)
fraction_multiply = _arithmetic("fraction_multiply", lambda n, d, m, e: (n * m, d * e), lambda x, y: x * y)
fraction_divide = _arithmetic("fraction_divide", lambda n, d, m, e: (n * e, d * m), lambda x, y: x / y)
FRACTION_ARITHMETIC = {"+": fraction_add, "-": fraction_subtract, "*": fraction_multiply, "/": fraction_divide}


def fraction_compare(op: str, a: Column, b: Column) -> Column:
    """Cross products of canonical parts; they fit decimal(38, 0)."""

    def part(x: Column, name: str) -> Column:
        return x.getField(name).cast("decimal(19,0)")

    return compare(op, part(a, "num") * part(b, "den"), part(b, "num") * part(a, "den"))


@F.arrow_udf(T.FloatType())
def f32_from_fraction(value: pa.Array) -> pa.Array:
    """The nearest float, ties to even; null for null."""
    num, den, null = _parts(value)
    _checked(den)
    out = (num / den).astype(np.float32)
    for i in np.flatnonzero((num > EXACT) | (num < -EXACT) | (den > EXACT)):
        out[i] = fraction_to_f32(Fraction(int(num[i]), int(den[i])))
    return pa.array(out, mask=null)
