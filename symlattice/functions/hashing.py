"""32-bit stable hashes as column expressions; arithmetic stays in 64 bits under ANSI mode."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF
#: Public FNV-1a parameters and the multipliers of a two-round xorshift mixer; fixed values.
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193
MIX = (0x21F0AAAD, 0xD35A2D97)


def _times(x: Column, c: int) -> Column:
    """x * c mod 2**32 of a 32-bit x, by its 16-bit halves."""
    low, high = x.bitwiseAND(0xFFFF) * F.lit(c), F.shiftrightunsigned(x, 16) * F.lit(c)
    return (low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(F.lit(MASK))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the bytes of a text."""
    digits = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(0)).cast("int")), lambda i: i * 2 < F.length(digits)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(bytes_, F.lit(FNV_BASIS).cast("long"), lambda h, b: _times(h.bitwiseXOR(b), FNV_PRIME))


#: Texts still going on, below which they end one by one.
FEW_TEXTS = 8


@F.arrow_udf(T.LongType())
def fnv1a_of(text: pa.Array) -> pa.Array:
    """fnv1a() of whole columns: all texts take a byte a step. Lambdas can't hold it."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, n = at[:-1], np.diff(at)
    h = np.full(len(n), FNV_BASIS, np.uint32)
    rows, k = np.flatnonzero(n), 0
    while len(rows) > FEW_TEXTS:
        h[rows] = (h[rows] ^ data[start[rows] + k]) * np.uint32(FNV_PRIME)
        k += 1
        rows = rows[n[rows] > k]
    for i in rows.tolist():
        x = int(h[i])
        for b in data[start[i] + k : start[i] + n[i]].tobytes():
            x = (x ^ b) * FNV_PRIME & MASK
        h[i] = x
    return pa.array(h.astype(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    for times in MIX:
        x = x * np.uint32(times)
        x ^= x >> np.uint32(15)
    return x


@F.arrow_udf(T.LongType())
def u64_of(x: pa.Array) -> pa.Array:
    """u64() of whole columns. Lambdas can't hold it."""
    y = pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    low, high = _mixed(y.astype(np.uint32)), _mixed((y >> np.uint64(32)).astype(np.uint32))
    spread = low + np.uint32(0x9E3779B9) + (high << np.uint32(6)) + (high >> np.uint32(2))
    return pa.array((high ^ spread).astype(np.int64), mask=np.asarray(x.is_null()))


def _let(x: Column, f) -> Column:
    """f of x, which is evaluated once: an expression that repeats its argument doubles with every step."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def mix32(x: Column) -> Column:
    folded = lambda y, n: y.bitwiseXOR(F.shiftrightunsigned(y, n))
    once = _let(_let(x, lambda y: folded(y, 16)), lambda y: _times(y, MIX[0]))
    twice = _let(_let(once, lambda y: folded(y, 15)), lambda y: _times(y, MIX[1]))
    return _let(twice, lambda y: folded(y, 15))


def combine(first: Column, rest: Column) -> Column:
    """One step of a right fold: rest is the hash of what follows."""
    spread = lambda r: (first + F.lit(0x9E3779B9) + F.shiftleft(r, 6) + F.shiftrightunsigned(r, 2)).bitwiseAND(F.lit(MASK))
    return _let(rest, lambda r: r.bitwiseXOR(spread(r)))


def hex32(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(x), 8, "0")))


def u64(x: Column) -> Column:
    """Hash of 64 bits, signed or not: of its lower half and then its upper."""
    return combine(mix32(x.bitwiseAND(F.lit(MASK))), mix32(F.shiftrightunsigned(x, 32)))


def small(x: int | str) -> Column:
    """Hash of a number of up to 32 bits, or of a character's code: a constant."""
    h = ord(x) if isinstance(x, str) else x
    h ^= h >> 16
    for times in MIX:
        h = h * times & MASK
        h ^= h >> 15
    return F.lit(h).cast("long")


def flag(x: Column) -> Column:
    return F.when(x, small(1)).otherwise(small(0))


def together(*hashes: Column) -> Column:
    """Hash of several values, combined from the last to the first."""
    out = hashes[-1]
    for h in reversed(hashes[:-1]):
        out = combine(h, out)
    return out


def decayed(first: Column, second: Column, bits: int) -> Column:
    """Two hashes in one, of which the second leaves the upper bits alone."""
    return first.bitwiseXOR(F.shiftrightunsigned(second, bits))


def decayed_all(hashes: Column, bits: int) -> Column:
    """An array of hashes in one, each with its followers decayed: the last one the most."""
    return F.aggregate(F.reverse(hashes), F.lit(0).cast("long"), lambda rest, h: decayed(h, rest, bits))
