"""Prefix scans: inclusive and exclusive, whole, segmented or per tile, with a grand total, over any monoid."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.operators.monoid import ADD, Monoid
from ordwise.operators.positional import BUCKET, prefix
from ordwise.operators.reduce import reduce, tile_reduce


def scan(
    df: DataFrame,
    value: str,
    m: Monoid = ADD,
    kind: str = "exclusive",
    pos: str = "pos",
    partition_by: Sequence[str] = (),
    total_at_end: bool = False,
    identity: bool = True,
    out: str = "scanned",
    strategy: str = "auto",
    bucket: int = BUCKET,
) -> DataFrame:
    """`df` with the scan of `value` in order of `pos`, within each partition.

    An exclusive scan starts with the identity, or with null if `identity` is off. total_at_end adds one row at
    position n (n the number of rows) with the grand total and nulls elsewhere; it has no partitions. Nulls are skipped.
    """
    if kind not in ("exclusive", "inclusive"):
        raise ValueError(kind)
    of = df.schema[value].dataType
    names = [f"__p{i}" for i in range(len(m.parts))]
    outs = {n: (p.extract(F.col(value)), p, p.identity(of) if identity else None) for n, p in zip(names, m.parts)}
    scanned = prefix(df, outs, [pos], partition_by, kind == "inclusive", strategy, bucket)
    scanned = scanned.select(*df.columns, m.finish(*map(F.col, names)).alias(out))
    if not total_at_end:
        return scanned
    if partition_by:
        raise ValueError("a total at the end belongs to a scan without partitions")
    total = reduce(df, value, m, out).crossJoin(df.agg(F.count(F.lit(1)).alias(pos)))  # one row by one row
    return scanned.unionByName(total.select(pos, F.col(out).cast(scanned.schema[out].dataType)), allowMissingColumns=True)


def tile_scan(df: DataFrame, value: str, tile: int, m: Monoid = ADD, kind: str = "exclusive", pos: str = "pos", identity: bool = True, out: str = "scanned") -> DataFrame:
    """Scan restarted every `tile` positions (the lanes of a warp, the items of a block), with each tile's aggregate."""
    tiled = df.withColumn("tile", F.floor(F.col(pos) / tile))
    s = scan(tiled, value, m, kind, pos, ["tile"], identity=identity, out=out, strategy="single")
    whole = tile_reduce(df, value, m, tile, pos, "aggregate").withColumnRenamed("tile", "__t")
    return s.join(whole, F.col("tile") == F.col("__t")).drop("__t")


def array_scan(array: Column, plus: Callable[[Column, Column], Column], start: Column, kind: str = "exclusive") -> Column:
    """Scan within an array, as a chain of prefixes; for short arrays."""
    first = 0 if kind == "exclusive" else 1
    upto = F.sequence(F.lit(first), F.size(array) - 1 + first)
    every = F.transform(F.when(F.size(array) > 0, upto), lambda i: F.aggregate(F.slice(array, 1, i), start, plus))
    return F.coalesce(every, F.transform(F.filter(array, lambda _: F.lit(False)), lambda _: start))
