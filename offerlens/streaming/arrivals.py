"""The change-only history of a stream in order of arrival, by ``transformWithState``: a late sighting is compared as a store that records on arrival does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import KEY, TOLERANCE
from ..operators.ledger import POINT, sound

STATE = "at long, seq long, price_euro double, in_stock boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(2**63)


class Arrivals(StatefulProcessor):
    """State of a key: its point of the largest time (then ``seq``), in RocksDB. A key that isn't seen for ``forget_ms`` loses it, by a timer."""

    def __init__(self, tolerance: float, forget_ms: int | None):
        self.tolerance, self.forget_ms = tolerance, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        got = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        at = got["at"].to_numpy()
        seq = got["seq"].fillna(NEVER).to_numpy(np.int64)
        order = np.lexsort((at, seq))
        last = self.last.get() if self.last.exists() else None
        before, kept = last, []
        prices, stocks = got["price_euro"].to_numpy(), got["in_stock"].tolist()
        for i in order.tolist():
            stock = None if pd.isna(stocks[i]) else bool(stocks[i])
            if last is None or abs(prices[i] - last[2]) >= self.tolerance or stock is not last[3]:
                kept.append(i)
                if last is None or (at[i], seq[i]) >= tuple(last[:2]):
                    last = (int(at[i]), int(seq[i]), float(prices[i]), stock)
        if last is not before:
            self.last.update(last)
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        if kept:
            yield got.iloc[kept].drop(columns=["at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def arrivals(sightings: DataFrame, tolerance: float = TOLERANCE, forget_ms: int | None = None) -> DataFrame:
    """The points of a stream of sightings, as ``Ledger`` keeps them: batches in order, in a batch by ``seq``.

    The session's state store must be RocksDB (``PROVIDER``). A task holds one key's sightings of a micro-batch, as numbers; bound the batch at the source.
    With ``forget_ms`` the state stays in proportion to the keys seen in that time; a forgotten key begins anew with its next sighting. Timers keep such a
    query running: give it a trigger by processing time (``availableNow`` wouldn't end).
    """
    timed = sound(sightings).withColumn("at", F.coalesce(F.unix_micros("recorded_at"), F.lit(NEVER)))
    return timed.groupBy(*KEY).transformWithStateInPandas(Arrivals(tolerance, forget_ms), POINT, "Append", "None" if forget_ms is None else "ProcessingTime")
