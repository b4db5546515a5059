"""Bounds of Spark's numeric types: the identities of min and max, and zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, IntegralType, LongType, ShortType

_BITS = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}


def category(kind: DataType) -> str:
    """'signed' (integers), 'unsigned' (whole decimals, which hold what has no type of its own), 'floating' or 'other'."""
    if isinstance(kind, IntegralType):
        return "signed"
    if isinstance(kind, DecimalType):
        return "unsigned" if kind.scale == 0 else "floating"
    return "floating" if isinstance(kind, (FloatType, DoubleType)) else "other"


def largest(kind: DataType) -> Column:
    """The greatest value below NaN; raises TypeError for types without one."""
    if type(kind) in _BITS:
        return F.lit((1 << (_BITS[type(kind)] - 1)) - 1).cast(kind)
    if isinstance(kind, DecimalType):
        return F.lit("9" * (kind.precision - kind.scale) + "." + "9" * kind.scale).cast(kind)
    if isinstance(kind, (FloatType, DoubleType)):
        return F.lit(float("inf")).cast(kind)
    raise TypeError(f"{kind.simpleString()} has no bounds")


def least(kind: DataType) -> Column:
    if type(kind) in _BITS:
        return F.lit(-(1 << (_BITS[type(kind)] - 1))).cast(kind)
    return -largest(kind)


def zero(kind: DataType) -> Column:
    return F.lit(0).cast(kind)


def vector(*lanes: Column) -> Column:
    """A struct of two to four lanes x, y, z, w."""
    if not 2 <= len(lanes) <= 4:
        raise ValueError("two to four lanes")
    return F.struct(*[c.alias(n) for c, n in zip(lanes, "xyzw")])
