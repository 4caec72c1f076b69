"""Scalar functions as column expressions, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(v: Column) -> Column:
    """Bits of the magnitude: 0 for 0, else floor(log2(abs(v))) + 1."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long")))).cast("int")


def value_bits(v: Column) -> Column:
    """The low `category` bits of v, a negative one in one's complement; 0 for 0."""
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), category(v)) - 1
    return F.when(v >= 0, v.cast("long")).otherwise(v.cast("long") + ones)


def bits_needed(n: Column) -> Column:
    """Ceiling of log2(n)."""
    # digits of n - 1: exact, where a quotient of logarithms is not
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long")))).cast("int")


def round_up(n: Column, step: int) -> Column:
    """n rounded up to a multiple of step."""
    return F.floor((n + (step - 1)) / F.lit(step)).cast("int") * step


def clamp(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def wrap_byte(v: Column) -> Column:
    """v as an unsigned byte, wrapping around."""
    return v.cast("long").bitwiseAND(255).cast("int")


def u16_hex(n: Column) -> Column:
    """Two bytes, high one first, as hexadecimal digits; wraps beyond 65535."""
    return F.lpad(F.hex(n.cast("long").bitwiseAND(65535)), 4, "0")


def byte_hex(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long").bitwiseAND(255)), 2, "0")


def code_text(code: Column, length: Column) -> Column:
    """A code as binary digits of its length."""
    return F.when(length > 0, F.lpad(F.bin(code), length, F.lit("0"))).otherwise(F.lit(""))
