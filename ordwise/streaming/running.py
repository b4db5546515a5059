"""A running prefix carried across micro-batches, per key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_sum(stream: DataFrame, key: str = "key", pos: str = "pos", value: str = "value") -> DataFrame:
    """A stream (key long, pos long, value long) to key, pos, running: the inclusive scan of each key's values.

    Rows of a key must arrive with rising positions from batch to batch; within a batch they are sorted. The state of
    a key is one number. Null values add nothing; rows with a null key form a key.
    """

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(pos, kind="stable")
        sums = total + rows[value].fillna(0).astype("int64").cumsum()
        state.update((int(sums.iloc[-1]),))
        yield pd.DataFrame({"key": rows[key], "pos": rows[pos], "running": sums})

    return stream.groupBy(key).applyInPandasWithState(step, "key long, pos long, running long", "total long", "append", GroupStateTimeout.NoTimeout)
