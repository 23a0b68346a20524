"""Small pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    ascii_only = F.octet_length(text) == F.length(text)  # there the quicker function does the same
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(docs: DataFrame, name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


_own: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which driver and executors share; ``discard`` removes all of a session.

    Only where the session names none and runs on one machine a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Removes all tables that this session has staged; results that read from them must be written by then."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "none").rpartition("/")[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    It cuts the lineage, survives lost executors and fixes generated row numbers.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, most_rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if it proves to have at most ``most_rows`` rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def keep_freed_memory() -> None:
    """Lets a Python worker reuse the memory of freed arrays instead of returning it to the system, where it would be faulted in again.

    Numpy over arrays of a megabyte spends most of its time on those faults. Where the C library has no ``mallopt`` nothing changes.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    trim_threshold, mmap_threshold = -1, -3
    for which in (trim_threshold, mmap_threshold):
        mallopt(which, 1 << 28)
