"""Sources and sinks: arrays and tables in, rows with positions out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ordwise.operators.positional import with_pos


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_positioned(spark: SparkSession, path: str, order: Sequence[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """A file source with `pos`, the dense rank in an order that makes rows distinct (files have none of their own)."""
    return with_pos(spark.read.options(**options).format(fmt).load(path), order)


def from_values(spark: SparkSession, values: Iterable, kind: str = "long", name: str = "v") -> DataFrame:
    """A local array as (pos, name)."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"pos long, `{name}` {kind}")


def to_values(df: DataFrame, name: str = "v", pos: str = "pos") -> list:
    """A column in position order, on the driver; for results that fit there."""
    return [r[0] for r in df.orderBy(pos).select(name).collect()]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")
