"""Operators that reduce and scan take: what is extracted from a row, how it adds up, and what comes out.

A monoid has one or more parts. A part has an aggregate function that Spark also uses as a window function and that
can aggregate its own results, a way to combine two of them, and an identity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ordwise.functions.types import largest, least


@dataclass(frozen=True)
class Part:
    agg: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    identity: Callable[[DataType], Column | None] = lambda _: None
    extract: Callable[[Column], Column] = lambda v: v

    def merge(self, a: Column, b: Column) -> Column:
        """Combine where either may be missing."""
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(self.combine(a, b))


@dataclass(frozen=True)
class Monoid:
    name: str
    parts: tuple[Part, ...]
    finish: Callable[..., Column] = field(default=lambda x: x)


ADD = Monoid("add", (Part(F.sum, lambda a, b: a + b, lambda _: F.lit(0)),))
MUL = Monoid("mul", (Part(F.product, lambda a, b: a * b, lambda _: F.lit(1.0)),))
MIN = Monoid("min", (Part(F.min, F.least, largest),))
MAX = Monoid("max", (Part(F.max, F.greatest, least),))
MEAN = Monoid(
    "mean",
    (
        Part(F.sum, lambda a, b: a + b, lambda _: F.lit(0.0), lambda v: v.cast("double")),
        Part(F.sum, lambda a, b: a + b, lambda _: F.lit(0), lambda v: v.isNotNull().cast("long")),
    ),
    lambda s, n: F.when(n > 0, s / n),
)
