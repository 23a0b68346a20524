"""The change-only history of a stream of sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import KEY, TOLERANCE

POINT = "product_id string, source string, recorded_at timestamp, seq long, price_euro double, in_stock boolean"
STATE = "price_euro double, in_stock boolean"


def changes(sightings: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Points whose price or stock differs from the last kept point of their product and source, which is the state.

    Within a micro-batch sightings count in order of time and ``seq``; one that arrives in a later batch is compared with the last
    point kept so far, as a store that records on arrival does.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["recorded_at", "seq"])
        last = state.getOption
        kept = []
        for i, (price, stock) in enumerate(zip(rows["price_euro"], rows["in_stock"], strict=True)):
            stock = None if pd.isna(stock) else bool(stock)
            if price > 0 and (last is None or abs(price - last[0]) >= tolerance or stock is not last[1]):
                last = (float(price), stock)
                kept.append(i)
        if last is not None:
            state.update(last)
        yield rows.iloc[kept]

    named = sightings.select(*KEY, sightings["recorded_at"].cast("timestamp").alias("recorded_at"), "seq", "price_euro", "in_stock")
    return named.groupBy(*KEY).applyInPandasWithState(step, POINT, STATE, "append", GroupStateTimeout.NoTimeout)
