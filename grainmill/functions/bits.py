"""Radix, bit and byte conversions as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_radix(c: Column, radix: int, width: int = 0) -> Column:
    """A number of 64 bits in radix 2 to 16, lower case, padded on the left with zeros to `width`."""
    if not 2 <= radix <= 16:
        raise ValueError("radix is 2 to 16")
    text = F.lower(F.conv(c.cast("string"), 10, radix))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text) if width else text


def hex_string(c: Column, width: int = 0) -> Column:
    return to_radix(c, 16, width)


def binary_string(c: Column, width: int = 0) -> Column:
    return to_radix(c, 2, width)


def from_radix(c: Column, radix: int) -> Column:
    """The number a text in the given radix stands for."""
    return F.conv(c, radix, 10).try_cast("bigint")


def extract_bits(c: Column, start: int, end: int) -> Column:
    """Bits [start, end) counted from the lowest."""
    return F.shiftrightunsigned(c.cast("bigint"), start).bitwiseAND(F.lit((1 << (end - start)) - 1).cast("bigint"))


def bit_at(c: Column, pos: int) -> Column:
    return F.bit_get(c.cast("bigint"), F.lit(pos)).cast("int")


def unsigned(c: Column, bits: int) -> Column:
    """A byte, short or int read as unsigned."""
    return c.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def int_bytes(c: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(c.cast("int").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def bytes_int(c: Column) -> Column:
    raw = F.conv(F.hex(c), 16, 10).cast("bigint")
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


def float_bytes(values: list[float], double: bool = False) -> bytes:
    """Big-endian bytes of floats or doubles."""
    return np.array(values, ">f8" if double else ">f4").tobytes()


def bytes_float(data: bytes, double: bool = False, start: int = 0, end: int | None = None) -> list[float]:
    """Floats or doubles [start, end) of big-endian bytes."""
    return np.frombuffer(data, ">f8" if double else ">f4")[start:end].astype(float).tolist()


def int_array_bytes(values: list[int]) -> bytes:
    return np.array(values, ">i4").tobytes()


def bytes_int_array(data: bytes) -> list[int]:
    return np.frombuffer(data, ">i4").astype(int).tolist()
