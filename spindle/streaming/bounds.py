"""The fold of points over a stream: a bound is kept if it is far enough from the last one kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Java class of the store that keeps the state of such queries; set as spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last double, seen double"


class Fold(StatefulProcessor):
    """Per key the last bound kept and the greatest time seen, two numbers whatever the stream's length."""

    def __init__(self, gap: float, first: float | None):
        self.gap, self.first = gap, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bounds", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen = self.state.get() if self.state.exists() else (None, None)
        out = []
        if seen is None and self.first is not None:
            last = self.first
            out.append((last, False))
        for t in sorted(float(t) for part in rows for t in part["t"]):
            if seen is not None and t < seen:
                out.append((t, True))
                continue
            seen = t
            if last is None or t - last >= self.gap:
                last = t
                out.append((t, False))
        self.state.update((last, seen))
        if out:
            bounds, late = zip(*out, strict=True)
            yield pd.DataFrame({"key": [key[0]] * len(out), "bound": bounds, "late": late})

    def close(self) -> None:
        pass


def kept_bounds(stream: DataFrame, key: str, t: str, gap: float, first: float | None = 0.0) -> DataFrame:
    """(key, bound, late) of a stream of points: what ``min_gap_fold`` keeps of each key's points, as they come.

    Within a batch points are taken in the order of their times. A point earlier
    than one that an earlier batch has brought is late: it is given out as such
    and changes nothing, as the bounds after it are out already. Points without a
    time or key are left out. Needs STORE as the state store.
    """
    points = stream.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t")).filter("key IS NOT NULL AND t IS NOT NULL")
    kind = points.schema["key"].dataType.simpleString()
    out = points.groupBy("key").transformWithStateInPandas(Fold(gap, first), f"key {kind}, bound double, late boolean", "Append", "None")
    return out.withColumnRenamed("key", key)
