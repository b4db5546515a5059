"""Positions: rows are ordered by a column `pos`, dense from 0. Prefix aggregates over an order, without one task
that holds all rows.

Strategies of a prefix aggregate:
  single  one window; for small inputs only, since without partition columns it has one partition.
  bucket  integer order column: rows of one bucket of positions are aggregated, the few bucket totals get their
          prefixes, and a window inside each bucket adds the rest. Join and window share one exchange. Totals of
          more than NEST bytes of rows get their prefixes in the same way, bucket by bucket of buckets.
  range   any order: rows are range-partitioned by it (a hot key splits by the columns after it) and written with
          their partition's number, which then plays the bucket's part.
  auto    single below SMALL bytes of files as Catalyst estimates them, else bucket for one integer column, else range.
All give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ordwise.operators.monoid import ADD, Part
from ordwise.plans.materialize import estimated_bytes, materialize

SMALL, NEST = 8 << 20, 1 << 40
#: Positions of a bucket.
BUCKET = 1 << 16


def prefix(
    df: DataFrame,
    outs: dict[str, tuple[Column, Part, Column | None]],
    order: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    inclusive: bool = False,
    strategy: str = "auto",
    bucket: int = BUCKET,
    nest: int = NEST,
) -> DataFrame:
    """`df` with a column for each of `outs`: name to (value, part, identity or None), aggregated over the rows before.

    Null values are skipped; where no row comes before, the identity (or null) stands. Order columns must make rows
    distinct for a defined result.
    """
    last = Window.currentRow if inclusive else -1
    if strategy == "auto":
        whole = len(order) == 1 and isinstance(df.schema[order[0]].dataType, IntegralType)
        strategy = "single" if estimated_bytes(df) < SMALL else "bucket" if whole else "range"
    if strategy == "single":
        w = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({n: _or(p.agg(v).over(w), i) for n, (v, p, i) in outs.items()})
    if strategy == "bucket":
        rows = df.withColumn("__prefix_bucket", F.floor(F.col(order[0]) / bucket))
    elif strategy == "range":
        rows = materialize(df.repartitionByRange(*partition_by, *order).withColumn("__prefix_bucket", F.spark_partition_id()))
    else:
        raise ValueError(strategy)
    keys = [*partition_by, "__prefix_bucket"]
    totals = rows.groupBy(*keys).agg(*[p.agg(v).alias(f"__prefix_total{i}") for i, (v, p, _) in enumerate(outs.values())])
    if estimated_bytes(df) < nest:  # as many buckets as one task orders with ease
        before = Window.partitionBy(*partition_by).orderBy("__prefix_bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumns({f"__prefix_before{i}": p.agg(F.col(f"__prefix_total{i}")).over(before) for i, (_, p, _) in enumerate(outs.values())})
    else:
        parts = {f"__prefix_before{i}": (F.col(f"__prefix_total{i}"), p, None) for i, (_, p, _) in enumerate(outs.values())}
        totals = prefix(totals.withColumnRenamed("__prefix_bucket", "__prefix_at"), parts, ["__prefix_at"], partition_by, False, "bucket", bucket, nest * bucket).withColumnRenamed("__prefix_at", "__prefix_bucket")
    base = totals.select(*[F.col(k).alias(f"__prefix_key{i}") for i, k in enumerate(keys)], *[f"__prefix_before{i}" for i in range(len(outs))])
    same = [F.col(k).eqNullSafe(F.col(f"__prefix_key{i}")) for i, k in enumerate(keys)]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    joined = rows.join(base, same)
    out = joined.withColumns({n: _or(p.merge(F.col(f"__prefix_before{i}"), p.agg(v).over(within)), d) for i, (n, (v, p, d)) in enumerate(outs.items())})
    return out.select(*df.columns, *[n for n in outs if n not in df.columns])


def _or(value: Column, identity: Column | None) -> Column:
    return value if identity is None else F.coalesce(value, identity)


_COUNT = ADD.parts[0]


def with_pos(df: DataFrame, order: Sequence[str], pos: str = "pos", partition_by: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """`df` with its dense rank from 0 in `order` (which must make rows distinct), per partition if given."""
    return prefix(df, {pos: (F.lit(1).cast("long"), _COUNT, F.lit(0).cast("long"))}, order, partition_by, strategy=strategy)


def rerank(df: DataFrame, pos: str = "pos", strategy: str = "auto") -> DataFrame:
    """Positions with gaps made dense again."""
    ranked = with_pos(df.withColumnRenamed(pos, "__old"), ["__old"], "__new", strategy=strategy)
    return ranked.select(*[F.col("__new").alias(pos) if c == pos else F.col(c) for c in df.columns])


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`; raises ValueError if rows share the keys (one aggregation and an action)."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)}: not unique")
    return df
