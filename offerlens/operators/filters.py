"""Filters on listings, folded into one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .identity import SIGNATURE, signature


@dataclass(frozen=True)
class Filters:
    min_price: float | None = None
    max_price: float | None = None
    in_stock_only: bool = False
    devices_only: bool = False
    brand: str | None = None
    min_inches: int | None = None
    max_inches: int | None = None

    def is_noop(self) -> bool:
        return self == Filters()

    def accepts(self) -> Column:
        """The conjunction over signed listings; a price of 0 (unknown) passes ``max_price``, an unknown size fails any bound."""
        held = [F.lit(True)]
        if self.min_price is not None:
            held.append(F.col("price_euro") >= self.min_price)
        if self.max_price is not None:
            held.append(F.col("price_euro") <= self.max_price)
        if self.in_stock_only:
            held.append(F.col("in_stock").eqNullSafe(True))
        if self.devices_only:
            held.append(F.col("kind") == "device")
        if self.brand is not None:
            needle = fold(F.lit(self.brand))
            held.append(F.coalesce(F.contains("brand_key", needle), F.lit(False)) | F.array_contains("name_tokens", needle))
        if self.min_inches is not None:
            held.append(F.col("screen_inches") >= self.min_inches)
        if self.max_inches is not None:
            held.append(F.col("screen_inches") <= self.max_inches)
        return F.coalesce(reduce(lambda a, b: a & b, held), F.lit(False))


def signed(listings: DataFrame) -> DataFrame:
    return listings if set(SIGNATURE) <= set(listings.columns) else signature(listings)


def apply_filters(listings: DataFrame, filters: Filters) -> DataFrame:
    return listings if filters.is_noop() else signed(listings).filter(filters.accepts())


def dropped_count(listings: DataFrame, filters: Filters) -> DataFrame:
    """kept and dropped rows, in one pass."""
    rows = signed(listings).select((F.lit(True) if filters.is_noop() else filters.accepts()).alias("ok"))
    return rows.agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"))
