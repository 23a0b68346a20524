"""Where tables of a session lie that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder of this application below the one that ``spark.checkpoint.dir`` names; a temporary one where it is unset, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/offers/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, read back."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str, each: int = 10_000) -> DataFrame:
    """The rows of a table dealt to tasks of about ``each``: a small file of many rows would be one task, however much is made of a row."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def discard(spark: SparkSession) -> None:
    """Removes all such tables of this session; results that read from them must be written by then."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "none").rpartition("/")[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
