"""Interval operators: expand, gather, scatter and move runs of consecutive rows. Counts are plain counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordwise.operators.search import expand_rows


def interval_expand(df: DataFrame, count: str = "count", value: str = "v", pos: str = "pos") -> DataFrame:
    """Each value `count` times, in order: pos, src_pos, rank, value."""
    return expand_rows(df, count, pos).select(F.col("slot").alias("pos"), F.col(pos).alias("src_pos"), "rank", value)


def _moved(intervals: DataFrame, data: DataFrame, read, write, value: str, pos: str) -> DataFrame:  # noqa: ANN001
    rows = expand_rows(intervals, "count", pos).select(read.alias("__from"), write.alias("__to"))
    d = data.select(F.col(pos).alias("__at"), value)
    return rows.join(d, F.col("__from") == F.col("__at")).select(F.col("__to").cast("long").alias("pos"), value)


def interval_gather(intervals: DataFrame, data: DataFrame, value: str = "v", pos: str = "pos") -> DataFrame:
    """Concatenation of data[gather_start .. gather_start + count) for each interval (pos, count, gather_start)."""
    return _moved(intervals, data, F.col("gather_start") + F.col("rank"), F.col("slot"), value, pos)


def interval_scatter(intervals: DataFrame, data: DataFrame, value: str = "v", pos: str = "pos") -> DataFrame:
    """Successive rows of data put at scatter_start, scatter_start + 1, ... for each interval (pos, count, scatter_start)."""
    return _moved(intervals, data, F.col("slot"), F.col("scatter_start") + F.col("rank"), value, pos)


def interval_move(intervals: DataFrame, data: DataFrame, value: str = "v", pos: str = "pos") -> DataFrame:
    """Both: each interval is read at gather_start and written at scatter_start."""
    return _moved(intervals, data, F.col("gather_start") + F.col("rank"), F.col("scatter_start") + F.col("rank"), value, pos)
