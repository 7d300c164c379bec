"""CityHash 1.0 (64 and 128 bits), as published by Google in 2011, for ids that must equal those of existing models.

`F.xxhash64` is the native hash of the engine; this one runs in an Arrow UDF. Integers are kept to 64 bits by masking.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the algorithm.
K0, K1, K2, K3 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557
MUL = 0x9DDFEA08EB382D69
MASK = (1 << 64) - 1


def _rot(x: int, n: int) -> int:
    return ((x >> n) | (x << (64 - n))) & MASK if n else x


def _mix(x: int) -> int:
    return x ^ (x >> 47)


def _pair(lo: int, hi: int) -> int:
    """Hash of two words (Hash128to64)."""
    a = _mix(((lo ^ hi) * MUL) & MASK)
    return (_mix(((hi ^ a) * MUL) & MASK) * MUL) & MASK


def _u64(s: bytes, at: int) -> int:
    return struct.unpack_from("<Q", s, at)[0]


def _short(s: bytes) -> int:
    """Up to 16 bytes."""
    n = len(s)
    if n > 8:
        a, b = _u64(s, 0), _u64(s, n - 8)
        return _pair(a, _rot((b + n) & MASK, n)) ^ b
    if n >= 4:
        a = struct.unpack_from("<I", s, 0)[0]
        return _pair((n + (a << 3)) & MASK, struct.unpack_from("<I", s, n - 4)[0])
    if n:
        y, z = s[0] + (s[n >> 1] << 8), n + (s[-1] << 2)
        return (_mix(((y * K2) ^ (z * K3)) & MASK) * K2) & MASK
    return K2


def _medium(s: bytes) -> int:
    """17 to 32 bytes."""
    n = len(s)
    a, b = (_u64(s, 0) * K1) & MASK, _u64(s, 8)
    c, d = (_u64(s, n - 8) * K2) & MASK, (_u64(s, n - 16) * K0) & MASK
    return _pair((_rot((a - b) & MASK, 43) + _rot(c, 30) + d) & MASK, (a + _rot(b ^ K3, 20) - c + n) & MASK)


def _half(s: bytes, first: int, z: int, extra: int) -> tuple[int, int]:
    """One of the two folds of 33 to 64 bytes."""
    a = first
    b, c = _rot((a + z) & MASK, 52), _rot(a, 37)
    a = (a + _u64(s, extra)) & MASK
    c = (c + _rot(a, 7)) & MASK
    a = (a + _u64(s, extra + 8)) & MASK
    return (a + z) & MASK, (b + _rot(a, 31) + c) & MASK


def _long(s: bytes) -> int:
    """33 to 64 bytes."""
    n = len(s)
    vf, vs = _half(s, (_u64(s, 0) + (_u64(s, n - 16) + n) * K0) & MASK, _u64(s, 24), 8)
    wf, ws = _half(s, (_u64(s, 16) + _u64(s, n - 32)) & MASK, _u64(s, n - 8), n - 24)
    r = _mix(((vf + ws) * K2 + (wf + vs) * K0) & MASK)
    return (_mix((r * K0 + vs) & MASK) * K2) & MASK


def _seeded(s: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    """Fold 32 bytes into two words."""
    w, x, y, z = (_u64(s, at + 8 * i) for i in range(4))
    a = (a + w) & MASK
    b = _rot((b + a + z) & MASK, 21)
    c = a
    a = (a + x + y) & MASK
    return (a + z) & MASK, (b + _rot(a, 44) + c) & MASK


def city64(s: bytes) -> int:
    """The 64-bit hash, unsigned."""
    n = len(s)
    if n <= 16:
        return _short(s)
    if n <= 32:
        return _medium(s)
    if n <= 64:
        return _long(s)
    x, y = _u64(s, n - 40), (_u64(s, n - 16) + _u64(s, n - 56)) & MASK
    z = _pair((_u64(s, n - 48) + n) & MASK, _u64(s, n - 24))
    v = _seeded(s, n - 64, n, z)
    w = _seeded(s, n - 32, (y + K1) & MASK, x)
    x = (x * K1 + _u64(s, 0)) & MASK
    for at in range(0, (n - 1) // 64 * 64, 64):
        x = (_rot((x + y + v[0] + _u64(s, at + 8)) & MASK, 37) * K1) & MASK
        y = (_rot((y + v[1] + _u64(s, at + 48)) & MASK, 42) * K1) & MASK
        x ^= w[1]
        y = (y + v[0] + _u64(s, at + 40)) & MASK
        z = (_rot((z + w[0]) & MASK, 33) * K1) & MASK
        v = _seeded(s, at, (v[1] * K1) & MASK, (x + w[0]) & MASK)
        w = _seeded(s, at + 32, (z + w[1]) & MASK, (y + _u64(s, at + 16)) & MASK)
        z, x = x, z
    return _pair((_pair(v[0], w[0]) + _mix(y) * K1 + z) & MASK, (_pair(v[1], w[1]) + x) & MASK)


def city64_seeds(s: bytes, seed0: int, seed1: int) -> int:
    return _pair((city64(s) - seed0) & MASK, seed1)


def city64_seed(s: bytes, seed: int) -> int:
    return city64_seeds(s, K2, seed)


def _rounds16(s: bytes, a: int, b: int) -> tuple[int, int]:
    """Two words from fewer than 128 bytes and two seed words."""
    n = len(s)
    if n <= 16:
        a = (_mix((a * K1) & MASK) * K1) & MASK
        c = (b * K1 + _short(s)) & MASK
        d = _mix((a + (_u64(s, 0) if n >= 8 else c)) & MASK)
    else:
        c = _pair((_u64(s, n - 8) + K1) & MASK, a)
        d = _pair((b + n) & MASK, (c + _u64(s, n - 16)) & MASK)
        a = (a + d) & MASK
        for at in range(0, n - 16, 16):
            first, second = (_mix((_u64(s, at + 8 * i) * K1) & MASK) * K1 & MASK for i in (0, 1))
            a = ((a ^ first) * K1) & MASK
            b ^= a
            c = ((c ^ second) * K1) & MASK
            d ^= c
    lo, hi = _pair(a, c), _pair(d, b)
    return lo ^ hi, _pair(hi, lo)


class _Wide:
    """The state that runs over 128 bytes and more, 64 at a time."""

    def __init__(self, s: bytes, a: int, b: int) -> None:
        self.x, self.y, self.z = a, b, (len(s) * K1) & MASK
        v0 = (_rot(b ^ K1, 49) * K1 + _u64(s, 0)) & MASK
        w0 = (_rot((b + self.z) & MASK, 35) * K1 + a) & MASK
        self.v = (v0, (_rot(v0, 42) * K1 + _u64(s, 8)) & MASK)
        self.w = (w0, (_rot((a + _u64(s, 88)) & MASK, 53) * K1) & MASK)

    def eat(self, s: bytes, at: int) -> None:
        x = (_rot((self.x + self.y + self.v[0] + _u64(s, at + 8)) & MASK, 37) * K1) & MASK
        y = (_rot((self.y + self.v[1] + _u64(s, at + 48)) & MASK, 42) * K1) & MASK
        x ^= self.w[1]
        y = (y + self.v[0] + _u64(s, at + 40)) & MASK
        z = (_rot((self.z + self.w[0]) & MASK, 33) * K1) & MASK
        v = _seeded(s, at, (self.v[1] * K1) & MASK, (x + self.w[0]) & MASK)
        self.w = _seeded(s, at + 32, (z + self.w[1]) & MASK, (y + _u64(s, at + 16)) & MASK)
        self.v, self.x, self.y, self.z = v, z, y, x


def city128_seed(s: bytes, a: int, b: int) -> tuple[int, int]:
    n = len(s)
    if n < 128:
        return _rounds16(s, a, b)
    t = _Wide(s, a, b)
    whole = n // 128 * 128
    for at in range(0, whole, 64):
        t.eat(s, at)
    x, y, z, v, w = t.x, t.y, t.z, t.v, t.w
    x = (x + _rot((v[0] + z) & MASK, 49) * K0) & MASK
    z = (z + _rot(w[0], 37) * K0) & MASK
    for back in range(32, n - whole + 32, 32):
        at = n - back
        y = (_rot((x + y) & MASK, 42) * K0 + v[1]) & MASK
        w = ((w[0] + _u64(s, at + 16)) & MASK, w[1])
        x = (x * K0 + w[0]) & MASK
        z = (z + w[1] + _u64(s, at)) & MASK
        w = (w[0], (w[1] + v[0]) & MASK)
        v = _seeded(s, at, (v[0] + z) & MASK, v[1])
    x, y = _pair(x, v[0]), _pair((y + z) & MASK, w[0])
    return (_pair((x + v[1]) & MASK, w[1]) + y) & MASK, _pair((x + w[1]) & MASK, (y + v[1]) & MASK)


def city128(s: bytes) -> tuple[int, int]:
    """The 128-bit hash as two unsigned words."""
    n = len(s)
    if n >= 16:
        return city128_seed(s[16:], _u64(s, 0) ^ K3, _u64(s, 8))
    if n >= 8:
        return city128_seed(b"", _u64(s, 0) ^ (n * K0 & MASK), _u64(s, n - 8) ^ K1)
    return city128_seed(s, K0, K1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def city_column(c: Column, bits: int = 64) -> Column:
    """The hash of a string column's UTF-8 bytes as signed bigint; bits=32 keeps the low half as signed int value. NULL stays NULL."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            if t is None:
                return None
            h = city64(t.encode())
            if bits == 32:
                h &= 0xFFFFFFFF
                return h - (1 << 32) if h >> 31 else h
            return signed(h)

        return s.map(one).astype("Int64")

    return run(c)
