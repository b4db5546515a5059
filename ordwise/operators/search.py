"""Sorted search, match flags, equality counts, partitions of a search or merge, load balancing, as-of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.operators.monoid import ADD, MAX, MIN
from ordwise.operators.positional import prefix

_ADD = ADD.parts[0]


def sorted_search(needles: DataFrame, haystack: DataFrame, key: str = "k", bound: str = "lower", strategy: str = "auto") -> DataFrame:
    """needles with `idx`, the first haystack position whose key isn't below (upper: is above) theirs, and `matched`.

    That position is a count of smaller (upper: not larger) keys, so both sides enter as distinct keys with counts:
    one prefix sum over those, joined back to the needles. Null needles get null, not matched; null haystack keys
    don't count. Rows of the haystack need no order of their own.
    """
    if bound not in ("lower", "upper"):
        raise ValueError(bound)
    counts = haystack.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    asked = needles.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.lit(0).cast("long").alias("__n"))
    keys = counts.unionByName(asked).groupBy("__k").agg(F.sum("__n").alias("__n"))
    found = prefix(keys, {"__idx": (F.col("__n"), _ADD, F.lit(0).cast("long"))}, ["__k"], inclusive=bound == "upper", strategy=strategy)
    out = needles.join(found, F.col(key) == F.col("__k"), "left")
    return out.select(*needles.columns, F.col("__idx").alias("idx"), F.coalesce(F.col("__n") > 0, F.lit(False)).alias("matched"))


def match_flags(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """`a` with `matched`: whether its key occurs in b."""
    there = b.select(F.col(key).alias("__k")).distinct().withColumn("__there", F.lit(True))
    return a.join(there, F.col(key) == F.col("__k"), "left").select(*a.columns, F.coalesce("__there", F.lit(False)).alias("matched"))


def match_count(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """One row: how many rows of a have a key in b."""
    return a.join(b.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi").agg(F.count(F.lit(1)).alias("matches"))


def equality_count(needles: DataFrame, haystack: DataFrame, key: str = "k", at_least_one: bool = False) -> DataFrame:
    """needles with `n`, the number of haystack rows with their key (at least one: as a left join emits)."""
    counts = haystack.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    n = F.coalesce("__n", F.lit(0).cast("long"))
    return needles.join(counts, F.col(key) == F.col("__k"), "left").select(*needles.columns, (F.greatest(n, F.lit(1)) if at_least_one else n).alias("n"))


def search_partitions(haystack: DataFrame, count: int, every: int, key: str = "k", bound: str = "lower") -> DataFrame:
    """Bounds of the positions 0, every, 2 * every, ... count in sorted integer keys: part, key and idx."""
    parts = haystack.sparkSession.range(-(-count // every) + 1)
    needles = parts.select(F.col("id").alias("part"), F.least(F.col("id") * every, F.lit(count)).cast("long").alias(key))
    return sorted_search(needles, haystack, key, bound).drop("matched")


def merge_path_partitions(a: DataFrame, b: DataFrame, every: int, key: str = "k") -> DataFrame:
    """Where each diagonal crosses the merge of sorted a and b: part, diagonal, a_count, b_count (rows of each before)."""
    from ordwise.operators.sorting import merged

    m = merged(a, b, key, ["pos"])
    n = m.agg(F.count(F.lit(1)).alias("n"))
    took = prefix(m.select("out", (F.col("src") == 0).cast("long").alias("from_a")), {"a_count": (F.col("from_a"), _ADD, F.lit(0).cast("long"))}, ["out"], inclusive=True)
    ends = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / every))).alias("part"), "n").select("part", F.least(F.col("part") * every, F.col("n")).alias("diagonal"))
    crossed = ends.join(took, F.col("diagonal") - 1 == F.col("out"), "left")
    taken = F.coalesce("a_count", F.lit(0).cast("long"))
    return crossed.select("part", "diagonal", taken.alias("a_count"), (F.col("diagonal") - taken).alias("b_count"))


#: Slots that one row is expanded to at once; more are dealt out first.
CHUNK = 1 << 14


def expand_rows(df: DataFrame, count: str, pos: str = "pos") -> DataFrame:
    """Each row repeated `count` times, with `slot` (place in the output), and `rank` (0 .. count - 1).

    A row with many copies is cut into chunks that are dealt to other tasks. Null and negative counts give none.
    """
    n = F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(0)).cast("long")
    rows = prefix(df.withColumn("__n", n), {"__off": (F.col("__n"), _ADD, F.lit(0).cast("long"))}, [pos]).where("__n > 0")
    rows = rows.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK))))
    rows = rows.repartition(pos, "__c")
    lo = F.col("__c") * CHUNK
    rows = rows.select("*", F.explode(F.sequence(lo, F.least(lo + CHUNK, F.col("__n")) - 1)).alias("rank"))
    return rows.select(*df.columns, (F.col("__off") + F.col("rank")).alias("slot"), "rank")


def load_balance(df: DataFrame, count: str = "count", pos: str = "pos") -> DataFrame:
    """slot, owner, rank: for each output slot, the object that it belongs to."""
    return expand_rows(df, count, pos).select("slot", F.col(pos).alias("owner"), "rank")


def asof(left: DataFrame, right: DataFrame, on: str, payload: Sequence[str], by: Sequence[str] = (), forward: bool = False, strategy: str = "auto") -> DataFrame:
    """`left` with the payload of the last right row at or before it (forward: the first at or after it), else nulls.

    A running maximum over the union of both sides, so it needs no range join; among right rows with one `on` the
    greatest payload counts (forward: the least). Rows with a null `on` find nothing.
    """
    cols = [F.col(c).alias(f"__y{i}") for i, c in enumerate(payload)]
    r = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("__on"), F.struct(F.col(on).alias("__on"), *cols).alias("__r"), F.lit(1 if forward else 0).alias("__side"), F.lit(None).cast("long").alias("__id"))
    numbered = left.withColumn("__row", F.struct(*left.columns))
    lt = numbered.select(*by, F.col(on).alias("__on"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(0 if forward else 1).alias("__side"), F.xxhash64("__row").alias("__id"), "__row")
    both = lt.unionByName(r, allowMissingColumns=True)
    order = ["__on", "__side", "__id"]
    if forward:  # the least row after is the least before in the opposite order
        order = [F.col(c).desc() for c in order]
    out = prefix(both, {"__m": (F.col("__r"), (MIN if forward else MAX).parts[0], None)}, order, by, inclusive=True, strategy=strategy)
    got = out.where(F.col("__row").isNotNull()).withColumn("__m", F.when(F.col("__on").isNotNull(), F.col("__m")))
    return got.select("__row.*", *[F.col(f"__m.__y{i}").alias(c if c not in left.columns else f"right_{c}") for i, c in enumerate(payload)])


def packed(idx: Column, matched: Column) -> Column:
    """Index and match flag in one word: bit 31 is set on a match."""
    return F.when(matched, idx.cast("long").bitwiseOR(F.lit(1 << 31))).otherwise(idx.cast("long"))
