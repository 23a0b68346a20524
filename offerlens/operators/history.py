"""Change-only price history, and what is derived from it.

Storage is a log of sightings; products, history and reports are DataFrames over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["product_id", "source"]
TOLERANCE = 0.005


def changes(sightings: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The points that are kept: price over 0 and price or stock different from the last *kept* point (in order of time, seq).

    The comparison is with the last kept point, not the last sighting, so slow drift is kept in time; that needs a fold over
    a key's sightings in order. Spark sorts them by key on disk, and a task walks through them with one point in memory,
    so a key may have any number of sightings.
    """
    rows = sightings.filter("price_euro > 0").select(*KEY, "recorded_at", "seq", "price_euro", "in_stock")
    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, "recorded_at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            kept = []
            for i, (product, source, price, stock) in enumerate(zip(batch["product_id"], batch["source"], batch["price_euro"], batch["in_stock"], strict=True)):
                stock = None if pd.isna(stock) else bool(stock)
                if last is None or last[:2] != (product, source) or abs(price - last[2]) >= tolerance or stock is not last[3]:
                    last = (product, source, price, stock)
                    kept.append(i)
            yield batch.iloc[kept]

    return ordered.mapInPandas(run, rows.schema)


def latest(history: DataFrame) -> DataFrame:
    """The last point of every product and source."""
    at = F.max_by(F.struct("price_euro", "in_stock", "recorded_at"), F.struct("recorded_at", "seq"))
    return history.groupBy(*KEY).agg(at.alias("p")).select(*KEY, "p.price_euro", "p.in_stock", "p.recorded_at")


def products(sightings: DataFrame) -> DataFrame:
    """Products as repeated upserts leave them: name and url of the last sighting, other facts of the last that had them."""
    order = F.struct("recorded_at", "seq")
    last = [F.max_by(c, order).alias(c) for c in ("name", "url")]
    learned = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("image_url", "ean", "sku", "brand")]
    return sightings.groupBy(*KEY).agg(*last, *learned, F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"))


def history_of(history: DataFrame, product_id: str, source: str, limit: int = 30, oldest_first: bool = False) -> DataFrame:
    """One product's newest points, newest first; or the same points in the order in which they came."""
    found = history.filter((F.col("product_id") == product_id) & (F.col("source") == source)).orderBy(F.desc("recorded_at"), F.desc("seq")).limit(limit)
    return found.orderBy("recorded_at", "seq") if oldest_first else found


def newest(history: DataFrame, limit: int) -> DataFrame:
    """The newest points of every product and source, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("recorded_at"), F.desc("seq")))
    return history.withColumn("rank", rank).filter(F.col("rank") <= limit)


def spread(points: DataFrame, multi_only: bool = True) -> DataFrame:
    """Cheapest, highest, savings and number of retailers of every product, over latest points."""
    per = points.groupBy("product_id").agg(F.min("price_euro").alias("cheapest"), F.max("price_euro").alias("highest"), F.count_distinct("source").alias("retailer_count"))
    per = per.withColumn("savings", F.greatest(F.col("highest") - F.col("cheapest"), F.lit(0.0)))
    return per.filter("retailer_count > 1") if multi_only else per


def first_by_source(listings: DataFrame, limit: int, page_cap: int = 100, caps: dict[str, int] | None = None) -> DataFrame:
    """The first rows of each source's reply (none for a limit of 0), no more than its page holds: ``caps`` by source, else ``page_cap``."""
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("arrival"))
    most = F.lit(min(limit, page_cap))
    for source, cap in (caps or {}).items():
        most = F.when(F.col("source") == source, min(limit, cap)).otherwise(most)
    return listings.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def stats(products_: DataFrame, history: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row: products, price_points, tracked."""
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(products_, "products").join(one(history, "price_points")).join(one(tracked, "tracked"))


def by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def matches(query: str) -> Column:
    """Name contains the query (letters A-Z in any case, % and _ are wildcards), or id, EAN or SKU equals it."""
    plain = lambda c: F.translate(c, _UP, _LOW)
    pattern = "%" + query.translate(str.maketrans(_UP, _LOW)).replace("\\", "\\\\") + "%"
    exact = [F.coalesce(F.col(c) == query, F.lit(False)) for c in ("product_id", "ean", "sku")]
    return plain(F.col("name")).like(pattern) | exact[0] | exact[1] | exact[2]


def search(products_: DataFrame, query: str, source: str | None = None, limit: int = 50) -> DataFrame:
    found = products_.filter(matches(query))
    found = found if source is None else found.filter(F.col("source") == source)
    return found.orderBy(F.desc("last_seen"), *KEY).limit(limit)
