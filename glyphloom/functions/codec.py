"""Integer codecs: rolling key, base-2^21 token ids, packed n-grams. Columns here, Python twins for any length."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 2166136261
PRIME = 31
U32 = 0xFFFFFFFF
DIGIT = 21
MAX_PACK = 5


# --- Python twins (the kernels use these) ---


def key_of(ints: Iterable[int], seed: int = SEED) -> int:
    h = seed
    for x in ints:
        h = (h * PRIME + x) & U32
    return h


def encode_id(cps: Sequence[int]) -> int:
    """One integer for a token of any length: digits are codepoint + 1. Domain 0..0x10FFFF."""
    out = 0
    for c in cps:
        if not 0 <= c <= 0x10FFFF:
            raise ValueError(f"not a codepoint: {c}")
        out = out << DIGIT | c + 1
    return out


def decode_id(ident: int) -> list[int]:
    if ident < 0:
        raise ValueError("a token id is not negative")
    out = []
    while ident:
        out.append((ident & (1 << DIGIT) - 1) - 1)
        ident >>= DIGIT
    return out[::-1]


def append_id(ident: int, *cps: int) -> int:
    """The id of the token with cps appended (one or several)."""
    for c in cps:
        ident = ident << DIGIT | c + 1
    return ident


def pop_id(ident: int, n: int = 1) -> tuple[int, list[int]]:
    """(id without its last codepoints, those codepoints in order): up to n; the empty id has none to give."""
    if not ident:
        raise ValueError("the empty token has nothing to pop")
    tail: list[int] = []
    while ident and len(tail) < n:
        tail.append((ident & (1 << DIGIT) - 1) - 1)
        ident >>= DIGIT
    return ident, tail[::-1]


def pack(ints: Sequence[int]) -> int:
    """Up to five low bytes, big end first, and their number in the lowest byte."""
    if len(ints) > MAX_PACK:
        raise ValueError("Too long to pack")
    v = 0
    for x in ints:
        v = v * 256 + (x & 255)
    return v * 256 + len(ints)


def unpack(v: int) -> list[int]:
    n, v = v & 255, v >> 8
    out = [0] * n
    for i in range(n - 1, -1, -1):
        out[i] = v & 255
        v >>= 8
    return out


# --- Arrays ---


def zigzag(v: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers as unsigned ones that are small if they are near 0."""
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(v: np.ndarray) -> np.ndarray:
    half = (v >> np.uint64(1)).view(np.int64)
    return half ^ -(v & np.uint64(1)).view(np.int64)


def pack_numbers(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number ends): seven bits a byte, low ones first, the high bit set if more follow."""
    width = np.ones(len(v), np.int64)
    for k in range(7, max(int(v.max(initial=0)).bit_length(), 1), 7):
        width += v >= np.uint64(1 << k)
    ends = np.cumsum(width)
    starts = ends - width
    out = np.zeros(int(width.sum()), np.uint8)
    for j in range(int(width.max(initial=0))):
        k = np.flatnonzero(width > j)
        out[starts[k] + j] = (v[k] >> np.uint64(7 * j)) & np.uint64(127) | np.where(width[k] > j + 1, np.uint64(128), np.uint64(0))
    return out, ends


def unpack_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each ends) of pack_numbers()."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for j in range(int((ends - starts).max(initial=0))):
        k = np.flatnonzero(ends - starts > j)
        out[k] |= (data[starts[k] + j] & 127).astype(np.uint64) << np.uint64(7 * j)
    return out, ends


# --- Columns ---


def rolling_key(ints: Column, seed: int = SEED) -> Column:
    """The 32-bit key of an array of integers, as BIGINT."""
    mask = F.lit(U32).cast("long")
    return F.aggregate(ints, F.lit(seed).cast("long"), lambda h, c: (h * PRIME + c.cast("long").bitwiseAND(mask)).bitwiseAND(mask))


def token_id(cps: Column) -> Column:
    """BIGINT id of a token of up to three codepoints; null beyond (use token_hex there)."""
    short = F.aggregate(cps, F.lit(0).cast("long"), lambda x, c: F.shiftleft(x, DIGIT).bitwiseOR(c.cast("long") + 1))
    return F.when(F.size(cps) <= 3, short)


def token_of_id(ident: Column) -> Column:
    """The codepoints of a BIGINT id."""
    digits = F.array(*[F.shiftright(ident, DIGIT * k).bitwiseAND(F.lit((1 << DIGIT) - 1)) for k in (2, 1, 0)])
    return F.transform(F.filter(digits, lambda d: d > 0), lambda d: (d - 1).cast("int"))


def token_hex(cps: Column) -> Column:
    """The id of a token of any length in hexadecimal, without leading zeros. Four digits of 21 bits are 21 of four."""
    padded = F.concat(F.array_repeat(F.lit(-1), F.pmod(-F.size(cps), F.lit(4))), cps)
    low = (1 << 40) - 1

    def four(d: Column) -> Column:
        pair = lambda i: F.shiftleft(F.get(d, i).cast("long") + 1, DIGIT).bitwiseOR(F.get(d, i + 1).cast("long") + 1)
        high = F.shiftleft(pair(0), 2).bitwiseOR(F.shiftright(pair(2), 40))
        return F.concat(F.lpad(F.hex(high), 11, "0"), F.lpad(F.hex(pair(2).bitwiseAND(F.lit(low))), 10, "0"))

    groups = F.get(F.transform(F.array(padded), lambda p: F.transform(F.filter(p, lambda _, i: i % 4 == 0), lambda _, j: four(F.slice(p, 4 * j + 1, 4)))), F.lit(0))
    return F.ltrim(F.array_join(groups, ""), F.lit("0"))


def token_of_hex(ident: Column) -> Column:
    """The codepoints of a token_hex id."""

    def digits(h: Column) -> Column:
        high, rest = (F.conv(F.substring(h, a, n), 16, 10).cast("long") for a, n in ((1, 11), (12, 10)))
        mask = F.lit((1 << DIGIT) - 1)
        third = F.shiftleft(high.bitwiseAND(F.lit(3)), 19).bitwiseOR(F.shiftright(rest, DIGIT))
        return F.array(F.shiftright(high, 23), F.shiftright(high, 2).bitwiseAND(mask), third, rest.bitwiseAND(mask))

    groups = F.regexp_extract_all(F.concat(F.repeat(F.lit("0"), F.pmod(-F.length(ident), F.lit(21))), ident), F.lit(".{21}"), F.lit(0))
    return F.transform(F.filter(F.flatten(F.transform(groups, digits)), lambda d: d > 0), lambda d: (d - 1).cast("int"))


def pack_column(ints: Column) -> Column:
    body = F.aggregate(ints, F.lit(0).cast("long"), lambda v, b: v * 256 + b.cast("long").bitwiseAND(F.lit(255).cast("long")))
    return F.when(F.size(ints) <= MAX_PACK, body * 256 + F.size(ints)).otherwise(F.raise_error(F.lit("Too long to pack")).cast("long"))


def unpack_column(v: Column) -> Column:
    n = v.bitwiseAND(F.lit(255).cast("long")).cast("int")
    at = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.call_function("shiftright", v, 8 * (i + 1)).bitwiseAND(F.lit(255).cast("long")).cast("int"))
