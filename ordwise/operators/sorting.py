"""Stable sorts, merges and segmented sorts. Order is a column: every result carries `out`, its dense rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.operators.monoid import ADD
from ordwise.operators.positional import prefix, with_pos
from ordwise.operators.search import sorted_search


def sort_pairs(df: DataFrame, key: str = "k", pos: str = "pos", descending: bool = False, comparable: Callable[[Column], Column] | None = None, strategy: str = "auto") -> DataFrame:
    """`df` with `out`, its place when sorted by key; equal keys stay in position order, nulls come first.

    comparable maps the key to what is compared. Position breaks ties, so a hot key spreads over many tasks.
    """
    k = F.col(key) if comparable is None else comparable(F.col(key))
    if descending:
        ranked = with_pos(df.withColumns({"__k": k, "__p": -F.col(pos)}), ["__k", "__p"], "__up", strategy=strategy)
        total = df.agg(F.count(F.lit(1)).alias("__n"))
        return ranked.crossJoin(F.broadcast(total)).select(*df.columns, (F.col("__n") - 1 - F.col("__up")).alias("out"))  # one row
    return with_pos(df.withColumn("__k", k), ["__k", pos], "out", strategy=strategy).select(*df.columns, "out")


def sort_keys(df: DataFrame, key: str = "k", pos: str = "pos", descending: bool = False, strategy: str = "auto") -> DataFrame:
    """out, key."""
    return sort_pairs(df, key, pos, descending, strategy=strategy).select("out", key)


def sort_indices(df: DataFrame, key: str = "k", pos: str = "pos", descending: bool = False, strategy: str = "auto") -> DataFrame:
    """out, key and the position that the key came from (argsort)."""
    return sort_pairs(df, key, pos, descending, strategy=strategy).select("out", key, F.col(pos).alias("index"))


def radix_rank(df: DataFrame, start: int, bits: int, key: str = "k", pos: str = "pos") -> DataFrame:
    """`df` with digit (`bits` bits of a non-negative key from bit `start`) and rank, its stable place by digit."""
    digit = F.shiftright(F.col(key), start).bitwiseAND(F.lit((1 << bits) - 1))
    return with_pos(df.withColumn("digit", digit), ["digit", pos], "rank")


def radix_sort(df: DataFrame, key: str = "k", pos: str = "pos", first: int = 0, last: int = 63, descending: bool = False) -> DataFrame:
    """`df` with `out`, its stable place by bits first .. last - 1 of a non-negative key.

    Passes by digit would shuffle once a digit; one range exchange by the masked key gives the same places.
    """
    return sort_pairs(df, key, pos, descending, lambda k: F.shiftright(k, first).bitwiseAND(F.lit((1 << (last - first)) - 1)))


#: A sort that is cheap on nearly sorted input: the same rows, and Spark's sort is already so.
locality_sort_keys, locality_sort_pairs = sort_keys, sort_pairs


def block_sort(df: DataFrame, tile: int, key: str = "k", pos: str = "pos") -> DataFrame:
    """Each tile of positions sorted within itself: `out` is the place in the whole."""
    t = df.withColumn("__t", F.floor(F.col(pos) / tile))
    ranked = with_pos(t, [key, pos], "__r", ["__t"], strategy="single")
    return ranked.select(*df.columns, (F.col("__t") * tile + F.col("__r")).cast("long").alias("out"))


def sort_network(array: Column) -> Column:
    """A short array in ascending order, nulls last."""
    return F.array_sort(array)


def merged(a: DataFrame, b: DataFrame, key: str = "k", keep: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """The stable merge of two sorted inputs: out, src (0: a, 1: b), key and `keep`; a comes before b on ties.

    Nothing is sorted: a row of a moves up by the smaller keys of b, a row of b by those of a that aren't larger.
    """
    cols = list(dict.fromkeys([pos, key, *keep]))
    side = lambda x, y, bound, s: sorted_search(x.select(*cols), y, key, bound).withColumns({"out": (F.col(pos) + F.coalesce("idx", F.lit(0))).cast("long"), "src": F.lit(s)})
    return side(a, b, "lower", 0).unionByName(side(b, a, "upper", 1)).drop("idx", "matched")


def merge_keys(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    return merged(a, b, key).select("out", key)


def merge_pairs(a: DataFrame, b: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    return merged(a, b, key, [value]).select("out", key, value)


def segments_from_flags(df: DataFrame, head: str = "head", pos: str = "pos") -> DataFrame:
    """`df` with seg_id from 0; the first row starts a segment whether flagged or not."""
    flag = F.when(F.col(pos) == 0, F.lit(0)).otherwise(F.coalesce(F.col(head), F.lit(False)).cast("long")).cast("long")
    return prefix(df.withColumn("__h", flag), {"seg_id": (F.col("__h"), ADD.parts[0], F.lit(0).cast("long"))}, [pos], inclusive=True).drop("__h")


def segments_from_heads(df: DataFrame, heads: DataFrame, pos: str = "pos") -> DataFrame:
    """`df` with seg_id, from the positions where segments start; rows before the first start are segment 0."""
    starts = heads.select(F.col(pos).alias("__s")).distinct().where("__s > 0").select(F.col("__s").cast("long"), F.lit(1).cast("long").alias("__h"))
    flagged = df.join(starts, F.col(pos) == F.col("__s"), "left")
    out = prefix(flagged, {"seg_id": (F.col("__h"), ADD.parts[0], F.lit(0).cast("long"))}, [pos], inclusive=True)
    return out.select(*df.columns, "seg_id")


def segmented_sort(df: DataFrame, key: str = "k", pos: str = "pos", strategy: str = "auto") -> DataFrame:
    """Rows (with seg_id) sorted by key within their segment: `out` is the place in the whole. Always stable.

    Segments lie one after the other, so the order by (segment, key, position) is that of the whole; a hot segment
    spreads over many tasks.
    """
    return with_pos(df, ["seg_id", key, pos], "out", strategy=strategy)


def segsort_from_flags(df: DataFrame, key: str = "k", head: str = "head", pos: str = "pos") -> DataFrame:
    return segmented_sort(segments_from_flags(df, head, pos), key, pos)


def segsort_from_heads(df: DataFrame, heads: DataFrame, key: str = "k", pos: str = "pos") -> DataFrame:
    return segmented_sort(segments_from_heads(df, heads, pos), key, pos)
