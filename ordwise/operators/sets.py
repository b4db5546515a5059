"""Multiset operations on keys, and on keys with a payload. With multiplicities ca and cb a key comes out

intersection min(ca, cb), union max(ca, cb), difference max(ca - cb, 0), symmetric difference |ca - cb| times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.operators.positional import with_pos

OPS = ("intersection", "union", "difference", "symmetric")


def _times(op: str) -> Column:
    ca, cb = F.col("ca"), F.col("cb")
    return {"intersection": F.least(ca, cb), "union": F.greatest(ca, cb), "difference": F.greatest(ca - cb, F.lit(0)), "symmetric": F.abs(ca - cb)}[op]


def set_keys(a: DataFrame, b: DataFrame, op: str, key: str = "k", duplicates: bool = True) -> DataFrame:
    """The keys of the result, one row each. duplicates=False: inputs count as free of repeats.

    Keys meet as counts (partial sums before one shuffle) and are repeated after it, so repeats are never joined.
    Null is a key like others.
    """
    if op not in OPS:
        raise ValueError(op)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.select(key, one.alias("ca"), none.alias("cb")).unionByName(b.select(key, none.alias("ca"), one.alias("cb")))
    counts = both.groupBy(key).agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    if not duplicates:
        counts = counts.select(key, F.least("ca", F.lit(1)).alias("ca"), F.least("cb", F.lit(1)).alias("cb"))
    rows = counts.select(key, _times(op).alias("__n")).where("__n > 0")
    return rows.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i")).select(key)


def set_pairs(a: DataFrame, b: DataFrame, op: str, key: str = "k", value: str = "v", pos: str = "pos", ranked: bool = False) -> DataFrame:
    """key, occ (occurrence from 0) and the value of the row that a key comes from: a's where a has that occurrence.

    The i-th occurrence of a key in a pairs off with the i-th in b; of a difference the last ones of a remain.
    ranked adds `out`, the place by (key, occ).
    """
    if op not in OPS:
        raise ValueError(op)
    nth = lambda df, s: with_pos(df.select(key, pos, value), [pos], "occ", [key]).select(F.col(key).alias(f"__k{s}"), F.col("occ").alias(f"__o{s}"), F.col(value).alias(f"__v{s}"), F.lit(True).alias(f"__in{s}"))
    how = {"intersection": "inner", "union": "full_outer", "difference": "left", "symmetric": "full_outer"}[op]
    j = nth(a, "a").join(nth(b, "b"), F.col("__ka").eqNullSafe(F.col("__kb")) & (F.col("__oa") == F.col("__ob")), how)
    in_a, in_b = F.col("__ina").isNotNull(), F.col("__inb").isNotNull()
    if op == "difference":
        j = j.where(~in_b)
    elif op == "symmetric":
        j = j.where(in_a != in_b)
    pick = lambda x: F.when(in_a, F.col(f"__{x}a")).otherwise(F.col(f"__{x}b")) if op in ("union", "symmetric") else F.col(f"__{x}a")
    out = j.select(pick("k").alias(key), pick("o").alias("occ"), pick("v").alias(value))
    return with_pos(out, [key, "occ"], "out") if ranked else out
