"""The engine's functions over captured payloads and logs; ``tools`` puts a line-based JSON-RPC façade on top.

State lies in a folder, in tables that only grow: ``log`` (sightings by batch), ``history`` (the ledger of points: a batch is folded once, from the
last points of its keys) and ``actions`` (tracking and alerts). Every report is derived from them. ``sightings`` of folders of the first
layout (without batches, perhaps without newer columns) are read on, and folded as the first batch.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .folders import shared_dir
from .operators import alerts as A
from .operators import history as H
from .operators import matching as M
from .operators.filters import Filters, signed
from .operators.ledger import Ledger
from .sources import parsers, registry

SIGHTINGS = "product_id string, source string, recorded_at timestamp, seq long, name string, url string, image_url string, price_euro double, in_stock boolean, ean string, sku string, brand string"
ACTIONS = "action string, product_id string, source string, target_price double, acted_at timestamp, seq long"
COMPACT_EVERY = 32


@dataclass
class Found:
    """What a search or comparison gives: rows, the sources' errors, and counters of the pass that made the rows."""

    rows: DataFrame
    errors: DataFrame
    counts: dict[str, int]


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # a table that has not been written yet
            if "PATH_NOT_FOUND" in str(e):
                return empty
            raise

    @property
    def sightings(self) -> DataFrame:
        columns = [x.split()[0] for x in SIGHTINGS.split(", ")]
        return self._table("sightings", SIGHTINGS).select(*columns).unionByName(self._table("log", f"{SIGHTINGS}, batch int").select(*columns))

    @property
    def actions(self) -> DataFrame:
        return self._table("actions", ACTIONS)

    @property
    def products(self) -> DataFrame:
        return H.products(self.sightings)

    @property
    def ledger(self) -> Ledger:
        """The points; sightings of the first layout become its first batch."""
        found = Ledger(self.spark, f"{self.folder}/history")
        if found.mark < 0:
            old = self._table("sightings", SIGHTINGS)
            if not old.isEmpty():
                found.fold(old, 0)
        return found

    @property
    def history(self) -> DataFrame:
        return self.ledger.points

    @property
    def latest(self) -> DataFrame:
        return self.ledger.last_points().drop("seq")

    def record(self, listings: DataFrame) -> DataFrame:
        """Appends listings as a batch of sightings of now; the points that they add to the history. Only this batch is folded."""
        now = time.time_ns()
        order = [c for c in ("arrival", "rank", "query_id") if c in listings.columns]
        # sorted, so that numbers rise with arrival: a task's number, then the row's within it
        listings = listings.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
        place = F.shiftleft(F.shiftright("_place", 33), 24) + (F.col("_place") % (1 << 33))
        rows = listings.select(F.col("id").alias("product_id"), "source", F.lit(datetime.fromtimestamp(now / 1e9, UTC)).cast("timestamp").alias("recorded_at"), (F.lit(now) + place).alias("seq"), "name", "url", "image_url", "price_euro", "in_stock", "ean", "sku", "brand")
        return self._append(rows)

    def _append(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        ledger = self.ledger
        batch = ledger.mark + 1 if batch is None else batch
        path = f"{self.folder}/log/batch={batch}"
        rows.write.mode("overwrite").partitionBy("source").parquet(path)
        added = ledger.fold(self.spark.read.schema(SIGHTINGS).parquet(path), batch)
        if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
            ledger.compact()
        return added

    def follow(self, stream: DataFrame, checkpoint: str, **trigger: object):
        """A running query that records a stream of SIGHTINGS, a micro-batch a batch; it's the folder's only writer. A repeated micro-batch changes nothing."""
        first = self.ledger.mark + 1

        def add(rows: DataFrame, n: int) -> None:
            marked = f"{self.folder}/followed"
            seen = {r.n: r.batch for r in self._table("followed", "n long, batch int").collect()} if n else {}
            batch = seen.get(n, self.ledger.mark + 1 if seen or n else first)
            if n not in seen:
                self.spark.createDataFrame([(n, batch)], "n long, batch int").write.mode("append").parquet(marked)
            if batch > self.ledger.mark:
                self._append(rows, batch)

        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _counted(self, rows: DataFrame, label: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
        """``rows`` written once as a table, and counters observed on that pass."""
        seen, path = Observation(), shared_dir(self.spark, label)
        rows.observe(seen, *(c.alias(n) for n, c in counters.items())).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), {n: int(v or 0) for n, v in seen.get.items()}

    def _chosen(self, payloads: DataFrame, query: str | None, source: str | None) -> DataFrame:
        chosen = payloads if source is None else payloads.filter(F.col("source") == known_source(source))
        return chosen if query is None else chosen.filter((F.col("request_key") == query) | (F.col("kind") != "search"))

    def search(self, payloads: DataFrame, limit: int = 10, source: str | None = None, filters: Filters = Filters(), query: str | None = None) -> Found:
        """Listings of search payloads, parsed once; sightings are recorded before the filter. ``query`` chooses replies by their request."""
        chosen = self._chosen(payloads, query, source)
        listings = parsers.search_listings(chosen, limit)
        ok = F.lit(True) if filters.is_noop() else filters.accepts()
        rows = listings.withColumn("ok", F.lit(True)) if filters.is_noop() else signed(listings).withColumn("ok", ok)
        table, counts = self._counted(rows, "found", total_hits=F.count_if("ok"), filtered_out=F.count_if(~F.col("ok")))
        self.record(table)
        said = parsers.errors(chosen.filter("kind IN ('search', 'category')"))
        return Found(table.filter("ok").select(*listings.columns), said, counts)

    def compare(self, payloads: DataFrame, limit: int = 10, threshold: float = M.THRESHOLD, multi_only: bool = False, enrich: bool = False, filters: Filters = Filters(), query: str | None = None) -> Found:
        """Product groups over all sources' replies; filters come before the grouping. What is learnt from product pages is recorded too."""
        found = self.search(payloads, limit, None, filters, query)
        rows, counts = found.rows, found.counts | {"enriched": 0}
        if enrich:
            rows, more = self._counted(parsers.enrich(rows, parsers.product_listings(payloads)), "enriched", enriched=F.count_if("enriched"))
            counts |= more
            self.record(rows.filter("enriched"))
            rows = rows.drop("enriched")
        grouped = M.groups(signed(rows), threshold, multi_only)
        table, more = self._counted(grouped.withColumn("_order", F.monotonically_increasing_id()), "groups", group_count=F.count("*"))
        return Found(table.orderBy("_order").drop("_order"), found.errors, counts | more)

    def get_product(self, product_id: str, source: str) -> DataFrame:
        rows = self.products.join(self.latest.select(*H.KEY, "price_euro", "in_stock"), H.KEY, "left").withColumn("price_euro", F.coalesce("price_euro", F.lit(0.0)))
        return rows.filter((F.col("product_id") == product_id) & (F.col("source") == known_source(source)))

    def price_history(self, product_id: str, source: str, limit: int = 30) -> DataFrame:
        return H.history_of(self.history, product_id, known_source(source), limit)

    def _act(self, action: str, product_id: str, source: str, target: float | None = None) -> None:
        now = time.time_ns()
        row = [(action, product_id, known_source(source), target, datetime.fromtimestamp(now / 1e9, UTC), now)]
        self.spark.createDataFrame(row, ACTIONS).write.mode("append").parquet(f"{self.folder}/actions")

    def _has(self, rows: DataFrame, product_id: str, source: str) -> bool:
        return not rows.filter((F.col("product_id") == product_id) & (F.col("source") == known_source(source))).isEmpty()

    def track(self, product_id: str, source: str) -> None:
        self._act("track", product_id, source)

    def untrack(self, product_id: str, source: str) -> bool:
        existed = self._has(self.tracked(), product_id, source)
        self._act("untrack", product_id, source)
        return existed

    def set_alert(self, product_id: str, source: str, below: float) -> None:
        if not isinstance(below, (int, float)) or isinstance(below, bool) or not below > 0:
            raise ValueError("below must be a number greater than 0")
        self._act("alert", product_id, source, float(below))

    def clear_alert(self, product_id: str, source: str) -> bool:
        existed = self._has(A.alerts(self.actions), product_id, source)
        self._act("unalert", product_id, source)
        return existed

    def tracked(self) -> DataFrame:
        return A.tracked_report(A.tracked(self.actions), self.products, self.latest)

    def alerts(self) -> DataFrame:
        return A.report(A.alerts(self.actions), self.products, self.latest)

    def refresh(self, payloads: DataFrame) -> dict:
        """Records the tracked products' pages; those without one are errors. Counters, errors, and the alerts that are reached, as DataFrames where rows may be many."""
        tracked, count = self._counted(A.tracked(self.actions).select(*H.KEY), "tracked", total=F.count("*"))
        pages = parsers.product_listings(payloads)
        due = pages.join(tracked, (pages["id"] == tracked["product_id"]) & (pages["source"] == tracked["source"]), "left_semi")
        found, updated = self._counted(due, "pages", updated=F.count("*"))
        missing = tracked.join(found.select(F.col("id").alias("product_id"), "source"), H.KEY, "left_anti")
        failed = parsers.errors(payloads.filter("kind = 'product'")).groupBy(F.col("query_id").alias("product_id"), "source").agg(F.min("error").alias("error"))
        said = missing.join(failed, H.KEY, "left").select(*H.KEY, F.coalesce("error", F.concat("product_id", F.lit(" no longer listed"))).alias("error"))
        changed = self.record(found).count()
        return {**updated, "changed": changed, **count, "alerts_triggered": self.alerts().filter("triggered"), "errors": said.orderBy(*H.KEY)}

    def stats(self) -> dict:
        row = H.stats(self.products, self.history, A.tracked(self.actions)).first().asDict()
        return row | {"by_source": {r["source"]: r["count"] for r in H.by_source(self.products).collect()}}

    def store_search(self, query: str, source: str | None = None) -> DataFrame:
        return H.search(self.products, query, None if source is None else known_source(source))

    def handle(self, line: str, payloads: DataFrame | None = None) -> str | None:
        from .tools import handle

        return handle(self, line, payloads)


def known_source(text: str) -> str:
    found = registry.resolve(text)
    if found is None:
        raise ValueError(f"unknown source: {text}")
    return found
