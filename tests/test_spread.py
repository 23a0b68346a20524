"""Small files of many rows are dealt to tasks by rows, so that no task's rows grow with the table."""

from pathlib import Path

import pytest

from offerlens.folders import spread
from offerlens.plans import queries, replies


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """40,000 parts in one file, of about a MB, as one task reads it."""
    path = str(tmp_path_factory.mktemp("parts"))
    rows = spark.range(40_000).selectExpr("id AS p_partkey", "'a part' AS p_name", "'Brand#1' AS p_brand", "5 AS p_size", "10.5D AS p_retailprice", "'type' AS p_type")
    rows.coalesce(1).write.parquet(f"{path}/part.parquet")
    assert spark.read.parquet(f"{path}/part.parquet").rdd.getNumPartitions() == 1
    return path


def test_tasks_grow_with_rows(spark):
    for n, tasks in ((0, 1), (10, 1), (11, 2), (95, 10)):
        dealt = spread(spark.range(n), "id", 10)
        assert dealt.rdd.getNumPartitions() == tasks and dealt.count() == n


def test_titles_are_dealt_out(spark, parts):
    assert queries.titles(spark, parts).rdd.getNumPartitions() == 4


def test_captures_are_written_by_bounded_tasks(spark, parts):
    """A writing task sorts its lines by folder, so what it holds must not grow with the table."""
    folder = Path(replies.write_captures(spark, parts).removeprefix("file://"))
    files = list(folder.glob("source=power/kind=search/part-*"))
    assert len(files) >= 4 and max(len(f.read_text().splitlines()) for f in files) < 3_000  # of over 6,667
