"""Relational joins that return positions, in order, and those that keep rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.operators.positional import with_pos

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full_outer"}


def relational_join(a: DataFrame, b: DataFrame, kind: str = "inner", key: str = "k", pos: str = "pos", ordered: bool = False, sentinel: int | None = None, comparable: Column | None = None) -> DataFrame:
    """Pairs a_pos, b_pos of rows with equal keys; unmatched rows of the outer kinds have null (or `sentinel`).

    ordered adds `rank`: by a_pos, then b_pos, unmatched rows of b last in b's order. comparable, an expression of
    the key, replaces it where keys are equal by another rule. Null keys match nothing.
    """
    of = lambda df, p, k: df.select(F.col(pos).alias(p), (F.col(key) if comparable is None else comparable).alias(k))
    j = of(a, "a_pos", "__ka").join(of(b, "b_pos", "__kb"), F.col("__ka") == F.col("__kb"), KINDS[kind]).select("a_pos", "b_pos")
    if ordered:
        j = with_pos(j.withColumns({"__n": F.col("a_pos").isNull(), "__a": F.coalesce("a_pos", F.lit(-1)), "__b": F.coalesce("b_pos", F.lit(-1))}), ["__n", "__a", "__b"], "rank").drop("__n", "__a", "__b")
    if sentinel is not None:
        j = j.withColumns({c: F.coalesce(c, F.lit(sentinel).cast("long")) for c in ("a_pos", "b_pos")})
    return j


def semi_join(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    return a.join(b.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def anti_join(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """Rows of a whose key isn't in b; null keys are in nothing."""
    return a.join(b.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
