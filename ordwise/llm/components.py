"""Connected components of an edge table, in Spark rounds.

Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to the
least node it knows, until each component is a star around its least node. Every round is a few aggregations and
joins on the edges, written to the shared folder; no links or components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, forget, mark


def _hang(rows: DataFrame, label: str) -> DataFrame:
    """rows (n, v): every v beside the least of n and its v: (v, m). Both sides are shuffled, so a hot n can split."""
    least = cut(rows.groupBy("n").agg(F.min("v").alias("v")).select(F.col("n").alias("k"), F.least("n", "v").alias("m")), label)
    return rows.join(least, F.col("n") == F.col("k")).select("n", "v", "m")


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs to (node, root): every node of an edge with the least node it is linked to.

    Directions, repeats and self-links don't matter; no edges give no rows; rows with a null end are ignored.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    start = mark()
    e = cut(e, "edges")
    seen = _fingerprint(e)
    for i in range(max_rounds):
        both = e.select(F.col("u").alias("n"), "v").unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("v")))
        large = _hang(both, f"large{i}").where("v > n AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, f"star{i}")
        hung = _hang(large.select(F.col("u").alias("n"), "v"), f"small{i}")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select(F.col("n").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct(), f"edges{i}")
        forget(start, e)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
