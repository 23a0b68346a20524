"""Tracking and price alerts, derived from logs of events (action, product_id, source, target_price, acted_at, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import KEY


def _since(events: DataFrame, ends: str) -> DataFrame:
    """Events after the last one of the action ``ends`` of their product."""
    order = F.struct("acted_at", "seq")
    cut = events.filter(F.col("action") == ends).groupBy(*KEY).agg(F.max(order).alias("_cut"))
    return events.join(cut, KEY, "left").filter(F.col("_cut").isNull() | (order > F.col("_cut"))).drop("_cut")


def tracked(events: DataFrame) -> DataFrame:
    """Products that are tracked (an alert tracks too): the first time since the last untrack counts."""
    open_ = _since(events, "untrack").filter(F.col("action").isin("track", "alert"))
    return open_.groupBy(*KEY).agg(F.min("acted_at").alias("added_at"))


def alerts(events: DataFrame) -> DataFrame:
    """Alerts that stand: the last target, and the time of the first since the last clearing."""
    open_ = _since(events, "unalert").filter(F.col("action") == "alert")
    return open_.groupBy(*KEY).agg(F.max_by("target_price", F.struct("acted_at", "seq")).alias("target_price"), F.min("acted_at").alias("created_at"))


def triggered(price: Column, target: Column) -> Column:
    """A known price of more than 0 that has reached the target."""
    return F.coalesce((price > 0) & (price <= target), F.lit(False))


def report(standing: DataFrame, products: DataFrame, latest: DataFrame) -> DataFrame:
    """Alerts with name, url and current price; newest first."""
    rows = standing.join(products.select(*KEY, "name", "url"), KEY, "left").join(latest.select(*KEY, F.col("price_euro").alias("current_price")), KEY, "left")
    return rows.withColumn("triggered", triggered(F.col("current_price"), F.col("target_price"))).orderBy(F.desc("created_at"), *KEY)


def tracked_report(rows: DataFrame, products: DataFrame, latest: DataFrame) -> DataFrame:
    """Tracked products with what is known of them; newest first."""
    joined = rows.join(products.select(*KEY, "name", "url"), KEY, "left").join(latest.select(*KEY, "price_euro", "in_stock"), KEY, "left")
    return joined.orderBy(F.desc("added_at"), *KEY)
