"""Change-only history kept as a table, batch by batch.

A folder holds ``points/batch=<n>/bucket=<b>``: the points that batch n of sightings added. A batch is folded once: its own sightings only, from the last
point of each of their keys, which is read from the buckets of those keys alone. So a batch costs what it and its buckets hold, whatever the log holds.

* A batch is done when its folder is written whole (``_SUCCESS``); folding it again changes nothing and returns what it added.
  A batch that broke off is written anew. Batches are folded in order: the largest one done is the high-water mark, and an older one that isn't done is refused.
* ``compact`` writes the last points of all keys as ``last/batch=<n>``; later batches read that and the points after n instead of all points.
* A sighting is compared with the point of the largest time (then ``seq``) that its key has so far: one that comes late is compared with the newest point,
  not with the one before its own time, and doesn't become the newest. In a batch sightings go by ``seq``, the order in which they arrived.

Defined results: a price that is null, not a number or not over 0 is no point; a null stock is a value of its own; equal keys are equal texts, and a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import KEY, TOLERANCE

POINT = "product_id string, source string, recorded_at timestamp, seq long, price_euro double, in_stock boolean"
BUCKETS = 64


def replayed(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The new points of ``rows`` (POINT, and ``kept``: whether it's the key's last point already), of every key in order of arrival.

    Spark sorts by key on disk; a task walks through with one point in memory.
    """
    names = [x.split()[0] for x in POINT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        last: tuple | None = None
        for b in batches:
            new = []
            columns = (b.column(n).to_pylist() for n in ("product_id", "source", "at", "seq", "price_euro", "in_stock", "kept"))
            for i, (product, source, at, seq, price, stock, kept) in enumerate(zip(*columns, strict=True)):
                if (product, source) != key:
                    key, last = (product, source), None
                if kept:
                    last = (at, seq, price, stock)
                elif last is None or abs(price - last[2]) >= tolerance or stock is not last[3]:
                    new.append(i)
                    if last is None or (at, seq) >= last[:2]:
                        last = (at, seq, price, stock)
            yield b.take(pa.array(new, pa.int64())).select(names)

    dated = rows.withColumn("at", F.coalesce(F.unix_micros("recorded_at"), F.lit(-(2**63)))).withColumn("seq", F.coalesce("seq", F.lit(-(2**63))))
    ordered = dated.repartition(*KEY).sortWithinPartitions(*KEY, F.desc("kept"), "seq", "at")
    return ordered.mapInArrow(run, POINT)


def sound(sightings: DataFrame) -> DataFrame:
    """Sightings with a price, as POINT."""
    named = sightings.select(*KEY, sightings["recorded_at"].cast("timestamp").alias("recorded_at"), sightings["seq"].cast("long").alias("seq"), sightings["price_euro"].cast("double").alias("price_euro"), sightings["in_stock"].cast("boolean").alias("in_stock"))
    return named.filter((F.col("price_euro") > 0) & ~F.isnan("price_euro"))


class Ledger:
    """The points of a folder. ``fold`` adds a batch, ``points`` is the history."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, tolerance: float = TOLERANCE):
        self.spark, self.folder, self.buckets, self.tolerance = spark, folder.rstrip("/"), buckets, tolerance

    def _batches(self, name: str) -> list[int]:
        """Numbers of the batches that are done, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [str(x.getPath().getName()) for x in files.listStatus(path)]
        done = [n for n in found if n.startswith("batch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def _read(self, name: str, batches: list[int]) -> DataFrame:
        schema = f"{POINT}, bucket int"
        if not batches:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/batch={n}" for n in batches])
        return found.drop("batch")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        self._bucketed(rows).repartition("bucket", F.pmod(F.xxhash64("product_id", F.lit(1)), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={batch}")

    @property
    def mark(self) -> int:
        """The high-water mark: the last batch that is done, -1 before the first."""
        return max(self._batches("points"), default=-1)

    @property
    def points(self) -> DataFrame:
        return self._read("points", self._batches("points")).drop("bucket")

    def last_points(self, buckets: list[int] | None = None) -> DataFrame:
        """Each key's point of the largest time, from the newest compaction and the points after it; of some ``buckets`` only, if given."""
        base = self._batches("last")[-1:]
        rows = self._read("last", base).unionByName(self._read("points", [n for n in self._batches("points") if not base or n > base[0]]))
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))
        newest = F.max_by(F.struct("recorded_at", "seq", "price_euro", "in_stock"), F.struct(F.coalesce(F.unix_micros("recorded_at"), F.lit(-(2**63))).alias("at"), "seq"))
        return rows.groupBy(*KEY).agg(newest.alias("p")).select(*KEY, "p.*")

    def added(self, batch: int) -> DataFrame:
        """The points that a batch added."""
        return self._read("points", [batch] if batch in self._batches("points") else []).drop("bucket")

    def folding(self, sightings: DataFrame) -> DataFrame:
        """The points that a batch of sightings would add now."""
        new = self._bucketed(sound(sightings))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        keys = new.select(*(F.col(c).alias(f"_{c}") for c in KEY)).distinct()
        last = self.last_points(touched)
        last = last.join(keys, last["product_id"].eqNullSafe(keys["_product_id"]) & last["source"].eqNullSafe(keys["_source"]), "left_semi")
        return replayed(new.drop("bucket").withColumn("kept", F.lit(False)).unionByName(last.withColumn("kept", F.lit(True))), self.tolerance)

    def fold(self, sightings: DataFrame, batch: int) -> DataFrame:
        """Adds a batch, unless it's done; the points that it added."""
        if batch not in self._batches("points"):
            if batch <= self.mark:
                raise ValueError(f"batch {batch} comes after batch {self.mark}")
            self._write(self.folding(sightings), "points", batch)
        return self.added(batch)

    def compact(self) -> None:
        """Writes the last points as of the high-water mark."""
        if self.mark >= 0 and self.mark not in self._batches("last"):
            self._write(self.last_points(), "last", self.mark)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger: object):
        """A running query that folds a stream of sightings into this ledger; a repeated micro-batch changes nothing."""

        def add(rows: DataFrame, batch: int) -> None:
            self.fold(rows, batch)

        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
