"""Bit operations on 32-bit words, as expressions over long columns that hold 0 .. 2**32 - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = (1 << 32) - 1


def _word(x: Column) -> Column:
    return x.cast("long").bitwiseAND(F.lit(_ALL))


def popc(x: Column) -> Column:
    """Number of set bits."""
    return F.bit_count(_word(x)).cast("int")


def clz(x: Column) -> Column:
    """Leading zero bits, 32 for 0."""
    return (32 - F.when(_word(x) == 0, F.lit(0)).otherwise(F.length(F.bin(_word(x))))).cast("int")


def ffs(x: Column) -> Column:
    """One-based place of the lowest set bit, 0 for 0."""
    w = _word(x)
    return F.when(w == 0, F.lit(0)).otherwise(F.length(F.bin(w.bitwiseAND(-w)))).cast("int")


def brev(x: Column) -> Column:
    """The bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(_word(x)), 32, "0")), 2, 10).cast("long")


def bfe(x: Column, start: int, size: int) -> Column:
    """Bit field: `size` bits from bit `start`."""
    return F.shiftright(_word(x), start).bitwiseAND(F.lit((1 << size) - 1))


def bfi(x: Column, into: Column, start: int, size: int) -> Column:
    """`into` with `size` bits from bit `start` replaced by the low bits of x."""
    mask = (((1 << size) - 1) << start) & _ALL
    return F.shiftleft(_word(x).bitwiseAND(F.lit((1 << size) - 1)), start).bitwiseAND(F.lit(mask)).bitwiseOR(_word(into).bitwiseAND(F.lit(_ALL ^ mask)))


def prmt(x: Column, y: Column, selector: int) -> Column:
    """Four bytes picked from the eight of (x, y), x low, by the selector's low four nibbles (their low three bits)."""
    out = F.lit(0).cast("long")
    for i in range(4):
        k = selector >> (4 * i) & 7
        byte = F.shiftright(_word(x if k < 4 else y), 8 * (k % 4)).bitwiseAND(F.lit(255))
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


def div_up(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y).cast("long")
