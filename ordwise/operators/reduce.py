"""Reductions: over all rows, by key, by run of equal keys, by tile; ordered folds; histograms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.operators.compact import discontinuity
from ordwise.operators.monoid import ADD, Monoid
from ordwise.operators.positional import prefix


def _aggregates(df: DataFrame, value: str, m: Monoid, identity: bool, out: str) -> Column:
    kind = df.schema[value].dataType
    parts = []
    for p in m.parts:
        x = p.agg(p.extract(F.col(value)))
        none = p.identity(kind) if identity else None
        parts.append(x if none is None else F.coalesce(x, none))
    return m.finish(*parts).alias(out)


def reduce(df: DataFrame, value: str, m: Monoid, out: str = "result") -> DataFrame:
    """One row: the reduction of a column; of no rows, the identity (a mean: null). Nulls are skipped."""
    return df.agg(_aggregates(df, value, m, True, out))


def reduce_by_key(df: DataFrame, keys: Sequence[str], value: str, m: Monoid, out: str = "result") -> DataFrame:
    """One row per key, null keys being a key; partial sums come before the shuffle."""
    return df.groupBy(*keys).agg(_aggregates(df, value, m, False, out))


def reduce_by_run(df: DataFrame, key: str, value: str, m: Monoid, pos: str = "pos", out: str = "result") -> DataFrame:
    """One row per maximal run of equal keys in position order: run (from 0), the key, n and the reduction."""
    runs = run_ids(df, key, pos)
    return runs.groupBy("run", key).agg(F.count(F.lit(1)).alias("n"), _aggregates(df, value, m, False, out))


def run_ids(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """`df` with `run`, the number of its run of equal keys, from 0."""
    heads = discontinuity(df, key, pos).withColumn("__h", F.col("head").cast("long"))
    return prefix(heads, {"run": (F.col("__h"), ADD.parts[0], None)}, [pos], inclusive=True).withColumn("run", F.col("run") - 1).select(*df.columns, "run")


def tile_reduce(df: DataFrame, value: str, m: Monoid, tile: int, pos: str = "pos", out: str = "result") -> DataFrame:
    """One row per tile of `tile` positions."""
    return df.withColumn("tile", F.floor(F.col(pos) / tile)).groupBy("tile").agg(_aggregates(df, value, m, False, out))


def array_reduce(array: Column, plus: Callable[[Column, Column], Column], start: Column | None = None) -> Column:
    """Fold an array from the left, from `start` or else its first item; empty without start: null."""
    if start is not None:
        return F.aggregate(array, start, plus)
    return F.when(F.size(array) > 0, F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), F.get(array, F.lit(0)), plus))


def ordered_fold(df: DataFrame, value: str, plus: Callable[[Column, Column], Column], order: str = "pos", by: Sequence[str] = (), out: str = "result") -> DataFrame:
    """Left fold in order, for operators that don't commute (difference, quotient).

    Such a fold is serial by nature: a group's values meet in one row, so groups must be small.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))), lambda r: r["v"])
    return df.groupBy(*by).agg(rows.alias("__vs")).select(*by, array_reduce(F.col("__vs"), plus).alias(out))


def histogram_even(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of values in [low, high) in equal bins: bin (from 0), n. Empty bins have no row; other values none."""
    b = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("long")
    return df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(F.least(b, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_edges(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts by custom rising edges: bin i holds edges[i] <= value < edges[i + 1]."""
    e = F.array(*[F.lit(x) for x in edges])
    b = F.size(F.filter(e, lambda x: x <= F.col(value))).cast("long") - 1
    return df.where((F.col(value) >= edges[0]) & (F.col(value) < edges[-1])).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
