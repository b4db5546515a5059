"""Moving rows by position: gather, scatter, removal, insertion, selection, partition, shift, run heads, layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordwise.operators.monoid import ADD
from ordwise.operators.positional import BUCKET, SMALL, prefix, require_unique, rerank
from ordwise.plans.materialize import estimated_bytes

_ADD = ADD.parts[0]


def _zero() -> Column:
    return F.lit(0).cast("long")


def gather(index: DataFrame, data: DataFrame, at: str = "i", pos: str = "pos", how: str = "inner") -> DataFrame:
    """index (pos, at) to pos and data's columns at those positions; how='left' keeps places without data, as nulls."""
    d = data.withColumnRenamed(pos, "__at")
    return index.join(d, F.col(at) == F.col("__at"), how).drop("__at", at)


def scatter(df: DataFrame, at: str = "i", pos: str = "pos", check: bool = True) -> DataFrame:
    """Rows moved to the position that `at` names. Two rows for one place are an error (unless check is off)."""
    out = df.drop(pos).withColumnRenamed(at, pos)
    return require_unique(out, pos) if check else out


def load(df: DataFrame, n: int, default: object = None, value: str = "v", pos: str = "pos") -> DataFrame:
    """The first n places; with a default, places without a row are filled with it."""
    valid = df.where(F.col(pos) < n)
    if default is None:
        return valid
    places = df.sparkSession.range(n).withColumnRenamed("id", "__p")
    full = places.join(valid, F.col("__p") == F.col(pos), "left")
    return full.select(F.col("__p").alias(pos), F.coalesce(value, F.lit(default)).alias(value))


def store(df: DataFrame, n: int, old: DataFrame | None = None, value: str = "v", pos: str = "pos") -> DataFrame:
    """The guarded store: of rows placed past n - 1 none is written; places of `old` that none is written to stay."""
    new = df.where((F.col(pos) >= 0) & (F.col(pos) < n)).select(pos, value)
    if old is None:
        return new
    kept = old.select(pos, value).where(F.col(pos) < n).join(new.select(F.col(pos).alias("__p")), F.col(pos) == F.col("__p"), "left_anti")
    return new.unionByName(kept)


def two_source_gather(index: DataFrame, a: DataFrame, b: DataFrame, b_start: int, at: str = "i", pos: str = "pos") -> DataFrame:
    """Gather from a where the index is below b_start, else from b at index - b_start."""
    both = a.unionByName(b.withColumn(pos, F.col(pos) + b_start))
    return gather(index, both, at, pos)


def bulk_remove(df: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows whose position isn't in `index`, in order, positions dense again."""
    return rerank(df.join(index.select(F.col(pos).alias("__i")), F.col(pos) == F.col("__i"), "left_anti"), pos)


def bulk_insert(a: DataFrame, b: DataFrame, before: str = "i", pos: str = "pos") -> DataFrame:
    """Rows of a (pos, i, ...) put before b's row at position i; a is sorted by i and equal i keep a's order.

    Nothing is sorted: a row of a ends at i + its own position, a row of b moves up by the rows put before or at it.
    """
    cols = [c for c in b.columns if c != pos]
    moved = a.select((F.col(before) + F.col(pos)).cast("long").alias(pos), *cols)
    steps = a.groupBy(F.col(before).cast("long").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    rows = b.join(steps, F.col(pos) == F.col("__at"), "left")
    rows = prefix(rows, {"__up": (F.col("__n"), _ADD, _zero())}, [pos], inclusive=True)
    return moved.unionByName(rows.select((F.col(pos) + F.col("__up")).cast("long").alias(pos), *cols))


def select_if(df: DataFrame, condition: Column, pos: str = "pos") -> DataFrame:
    """Rows that satisfy the condition, positions dense again."""
    return rerank(df.where(condition), pos)


def partition_if(df: DataFrame, condition: Column, pos: str = "pos") -> DataFrame:
    """Selected rows first, then the others, each in order; a null condition counts as false."""
    c = F.coalesce(condition, F.lit(False))
    rows = df.withColumn("__c", c.cast("long"))
    rows = prefix(rows, {"__s": (F.col("__c"), _ADD, _zero()), "__r": (F.lit(1).cast("long"), _ADD, _zero())}, [pos])
    total = df.where(c).agg(F.count(F.lit(1)).alias("__total"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    to = F.when(F.col("__c") == 1, F.col("__s")).otherwise(F.col("__total") + F.col("__r") - F.col("__s"))
    return rows.select(*[to.alias(pos) if x == pos else F.col(x) for x in df.columns])


def _ordered(df: DataFrame, pos: str, before: int, after: int) -> tuple[DataFrame, Window, Column]:
    """`df` in buckets of positions, a window over each, and which rows are the bucket's own.

    A row also goes to the bucket of the rows up to `before` places after it and `after` places before it, so one
    exchange shows every row its neighbours. Small inputs are one bucket.
    """
    if estimated_bytes(df) < SMALL:
        return df, Window.orderBy(pos), F.lit(True)
    own, edge = F.floor(F.col(pos) / BUCKET), F.col(pos) % BUCKET
    to = lambda by: F.floor((F.col(pos) + by) / BUCKET)
    at = F.when((edge >= BUCKET - before) | (edge < after), F.array_distinct(F.array(own, to(before), to(-after)))).otherwise(F.array(own))
    return df.withColumn("__b", F.explode(at)), Window.partitionBy("__b").orderBy(pos), F.col("__b") == own


def shift(df: DataFrame, value: str, by: int = 1, default: object = None, pos: str = "pos", out: str = "shifted") -> DataFrame:
    """`df` with the value `by` places before (after, if negative). Positions are dense."""
    if abs(by) > BUCKET:  # farther than a neighbouring bucket: dense positions make it an equality join
        other = df.select((F.col(pos) + by).alias("__to"), F.struct(F.col(value).alias("v")).alias("__there"))
        rows, own, found = df.join(other, F.col(pos) == F.col("__to"), "left"), F.lit(True), F.col("__there")
    else:
        rows, w, own = _ordered(df, pos, max(by, 0), max(-by, 0))
        found = F.lag(F.struct(F.col(value).alias("v")), by).over(w)
    rows = rows.withColumn("__there", found).where(own)
    return rows.select(*df.columns, F.when(F.col("__there").isNotNull(), F.col("__there.v")).otherwise(F.lit(default)).alias(out))


def discontinuity(df: DataFrame, key: str, pos: str = "pos", equal: Callable[[Column, Column], Column] = Column.eqNullSafe) -> DataFrame:
    """`df` with `head` and `tail`: whether its key differs from the row before, or after (the ends: true).

    equal decides what counts as one key; where it gives null, the keys differ.
    """
    rows, w, own = _ordered(df, pos, 1, 1)
    k = F.struct(F.col(key).alias("k"))
    rows = rows.withColumns({"__before": F.lag(k).over(w), "__after": F.lead(k).over(w)}).where(own)
    differs = lambda c: F.col(c).isNull() | ~F.coalesce(equal(F.col(key), F.col(f"{c}.k")), F.lit(False))
    return rows.select(*df.columns, differs("__before").alias("head"), differs("__after").alias("tail"))


def to_striped(pos: Column, threads: int, items: int) -> Column:
    """Where the item at a blocked place goes in striped order: t * items + i to i * threads + t, within each tile."""
    tile, at = F.floor(pos / (threads * items)), pos % (threads * items)
    return (tile * (threads * items) + at % items * threads + F.floor(at / items)).cast("long")


def to_blocked(pos: Column, threads: int, items: int) -> Column:
    """The inverse of to_striped."""
    tile, at = F.floor(pos / (threads * items)), pos % (threads * items)
    return (tile * (threads * items) + at % threads * items + F.floor(at / threads)).cast("long")


def exchange(df: DataFrame, to: Column, pos: str = "pos") -> DataFrame:
    """Rows renumbered by an expression of their position or rank."""
    return df.withColumn(pos, to)


def counting(spark, n: int, start: int = 0, step: int = 1) -> DataFrame:  # noqa: ANN001
    """pos and value: start, start + step, ..."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * step + start).alias("value"))


def constant(spark, n: int, value: object) -> DataFrame:  # noqa: ANN001
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("value"))


def arg_extreme(df: DataFrame, value: str, largest: bool = False, pos: str = "pos") -> DataFrame:
    """One row: the position and value of the least (largest) value; of ties the first."""
    v, p = F.col(value), F.col(pos)
    best = F.max(F.struct(v.alias("v"), (-p).alias("p"))) if largest else F.min(F.struct(v.alias("v"), p.alias("p")))
    r = df.where(v.isNotNull()).agg(best.alias("r"))
    return r.select((-F.col("r.p") if largest else F.col("r.p")).alias(pos), F.col("r.v").alias(value))


def transform(df: DataFrame, **columns: Column) -> DataFrame:
    """Element-wise columns; lazy, fused into the scan that feeds it."""
    return df.withColumns(columns)
