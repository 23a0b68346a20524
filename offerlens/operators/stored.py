"""Tables that share one partitioning by (product_id, source), so that upserts, latest prices, tracking and alerts join without a shuffle.

Every table is bucketed and sorted by key. A table is written as a new version beside the old one and the name is moved to it then, so a job that
breaks off leaves the old version; a session that opens a folder declares the newest whole version of each table.

``upsert`` shuffles the batch only: the stored side is read bucket by bucket. Batches come in order of time: the batch's facts win where it states them.
Rows with a null in their key are kept as rows of their own key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alerts, history
from .history import KEY

BUCKETS = 64
LEARNED = ("image_url", "ean", "sku", "brand")


class Stored:
    """Bucketed tables of a folder; ``prefix`` sets their names in the session's catalogue apart."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.prefix, self.buckets = spark, folder.rstrip("/"), prefix, buckets

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [str(x.getPath().getName()) for x in files.listStatus(path)]
        whole = [v for v in found if v.startswith("v") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{v}/_SUCCESS"))]
        return sorted(int(v[1:]) for v in whole)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version of a table, from rows with KEY columns."""
        version = max(self._versions(name), default=0) + 1
        path, table = f"{self.folder}/{name}/v{version}", f"{self.prefix}_{name}_v{version}"
        # one file a bucket: the rows of a bucket are in one task
        rows = rows.repartition(self.buckets, *KEY)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        rows.write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def open(self, name: str) -> DataFrame | None:
        """The newest version; None before the first."""
        versions = self._versions(name)
        if not versions:
            return None
        path, table = f"{self.folder}/{name}/v{versions[-1]}", f"{self.prefix}_{name}_v{versions[-1]}"
        if not self.spark.catalog.tableExists(table):
            schema = ", ".join(f"`{c}` {t}" for c, t in self.spark.read.parquet(path).dtypes)
            self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def upsert(self, sightings: DataFrame) -> DataFrame:
        """Products after a batch of sightings."""
        new, old = history.products(sightings), self.open("products")
        return self.write("products", new if old is None else upserted(old, new))

    def report(self) -> DataFrame:
        """``alerts.report`` over the tables ``actions``, ``products`` and ``latest``."""
        return alerts.report(alerts.alerts(self.open("actions")), self.open("products"), self.open("latest"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Products of ``old`` and ``new``, whose facts win where they are stated; a name and URL always."""
    n = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns))
    both = old.join(n, [old[c].eqNullSafe(n[f"_{c}"]) for c in KEY], "full_outer")
    is_new = F.col("_last_seen").isNotNull()
    values = {c: F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)) for c in (*KEY, "name", "url")} | {c: F.coalesce(f"_{c}", c) for c in LEARNED}
    values |= {"first_seen": F.least("first_seen", "_first_seen"), "last_seen": F.greatest("last_seen", "_last_seen")}
    return both.select(*(values[c].alias(c) for c in new.columns))
