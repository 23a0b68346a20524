"""The incremental history and the history in order of arrival, against plain replays."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlens.operators import history as H
from offerlens.operators.ledger import Ledger
from offerlens.streaming import arrivals as S

SIGHTING = "product_id string, source string, recorded_at timestamp, seq long, price_euro double, in_stock boolean"
START = datetime(2024, 1, 1)


def random_batches(draw, late, batches=5, rows=120):
    """Sightings of few keys; with ``late`` some come long after their time."""
    out, seq = [], 0
    for b in range(batches):
        some = []
        for _ in range(rows):
            seq += 1
            minute = seq if not late or draw.random() < 0.7 else draw.randrange(seq + 50)
            price = draw.choice([10.0, 10.004, 10.005, 10.01, 12.0, 0.0, -1.0, None, float("nan")])
            some.append((draw.choice(["a", "b", "c", "é", None]), draw.choice(["x", "y"]), None if draw.random() < 0.02 else START + timedelta(minutes=minute), seq, price, draw.choice([True, True, False, None])))
        out.append(some)
    return out


def plain_replay(batches, tolerance=H.TOLERANCE):
    """Each sighting, as it comes, against the point of the largest time that its key has."""
    points, kept = {}, []
    for row in (r for b in batches for r in b):
        key, (at, seq, price, stock) = row[:2], row[2:]
        if price is None or not price > 0:
            continue
        order = (at is not None, at or START, seq)
        last = max(points.get(key, []), default=None, key=lambda p: p[0])
        if last is None or abs(price - last[1]) >= tolerance or stock is not last[2]:
            points.setdefault(key, []).append((order, price, stock))
            kept.append(row)
    return kept


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[3])


@pytest.mark.parametrize("late", [False, True])
def test_folding_by_batches(spark, tmp_path, late):
    batches = random_batches(random.Random(4), late)
    ledger = Ledger(spark, f"file://{tmp_path}/l", buckets=4)
    assert ledger.mark == -1 and ledger.points.collect() == [] and ledger.last_points().collect() == []
    for n, some in enumerate(batches):
        new = rows_of(ledger.fold(spark.createDataFrame(some, SIGHTING).repartition(3), n))
        assert new == [r for r in plain_replay(batches[: n + 1]) if r in some]
        if n == 2:
            ledger.compact()
            ledger.compact()
    assert rows_of(ledger.points) == plain_replay(batches)
    if not late:  # in order of time the full fold is the same
        whole = spark.createDataFrame([r for b in batches for r in b if r[2] is not None], SIGHTING)
        ordered = [[r for r in b if r[2] is not None] for b in batches]
        assert rows_of(H.changes(whole.filter("NOT isnan(price_euro)")).select(*ledger.points.columns)) == plain_replay(ordered)
    newest = {(r.product_id, r.source): r.seq for r in ledger.last_points().collect()}
    best = {}
    for r in plain_replay(batches):
        order = (r[2] is not None, r[2] or START, r[3])
        best[r[:2]] = max(best.get(r[:2], order), order)
    assert newest == {k: v[2] for k, v in best.items()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batches = random_batches(random.Random(5), True, 3)
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for n, some in enumerate(batches):
        ledger.fold(spark.createDataFrame(some, SIGHTING), n)
    before = rows_of(ledger.points)
    again = rows_of(ledger.fold(spark.createDataFrame(batches[1], SIGHTING), 1))
    assert rows_of(ledger.points) == before and again == [r for r in plain_replay(batches) if r in batches[1]]
    ledger.fold(spark.createDataFrame([], SIGHTING), 7)
    assert ledger.mark == 7 and rows_of(ledger.points) == before
    with pytest.raises(ValueError, match="batch 5"):
        ledger.fold(spark.createDataFrame(batches[0], SIGHTING), 5)


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    some = random_batches(random.Random(6), False, 2)
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    ledger.fold(spark.createDataFrame(some[0], SIGHTING), 0)
    ledger.fold(spark.createDataFrame(some[1][:20], SIGHTING), 1)
    (tmp_path / "l" / "points" / "batch=1" / "_SUCCESS").unlink()
    assert ledger.mark == 0 and rows_of(ledger.points) == plain_replay(some[:1])
    ledger.fold(spark.createDataFrame(some[1], SIGHTING), 1)
    assert rows_of(ledger.points) == plain_replay(some)


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    """The plan of a batch: files of the buckets of its keys, after the last compaction."""
    ledger = Ledger(spark, f"file://{tmp_path}/l", buckets=32)
    for n in range(4):
        ledger.fold(spark.range(200).select(F.col("id").cast("string").alias("product_id"), F.lit("x").alias("source"), F.lit(START).alias("recorded_at"), F.lit(n).cast("long").alias("seq"), F.lit(1.0 + n).alias("price_euro"), F.lit(True).alias("in_stock")), n)
        if n == 1:
            ledger.compact()
    one = spark.createDataFrame([("7", "x", START, 9, 50.0, True)], SIGHTING)
    plan, files = ledger.folding(one), ledger.folding(one).inputFiles()
    told = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    scans = re.findall(r"PartitionFilters: \[(.*)\]", told)
    bucket = ledger._bucketed(one).first().bucket
    assert len(scans) == 2 and all("(bucket#" in x and f" = {bucket})" in x for x in scans)
    assert files and not any("points/batch=0/" in f or "points/batch=1/" in f for f in files) and any("/last/batch=1/" in f for f in files)
    assert [r.price_euro for r in ledger.fold(one, 4).collect()] == [50.0]


def test_stream_into_a_ledger(spark, tmp_path):
    batches = random_batches(random.Random(7), True, 3, 60)
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for n, some in enumerate(batches):
        spark.createDataFrame(some, SIGHTING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger.follow(spark.readStream.schema(SIGHTING).parquet(f"{tmp_path}/in"), f"{tmp_path}/log").awaitTermination()
    assert ledger.mark == 2 and rows_of(ledger.points) == plain_replay(batches)


@pytest.mark.parametrize("forget", [None, 3_600_000])
def test_arrivals_by_plain_replay(spark, tmp_path, forget):
    """Late sightings over several micro-batches, with and without timers."""
    batches = random_batches(random.Random(8), True, 4, 60)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    try:
        for some in batches:
            spark.createDataFrame(some, SIGHTING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = S.arrivals(spark.readStream.schema(SIGHTING).parquet(f"{tmp_path}/in"), forget_ms=forget)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(once=True).start().awaitTermination()
        assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == plain_replay(batches)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_forgotten_keys_begin_anew(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    try:
        for n, product in enumerate(["a", "b", "a"]):
            spark.createDataFrame([(product, "x", START, n, 1.0, True)], SIGHTING).write.mode("append").parquet(f"{tmp_path}/in")
            stream = S.arrivals(spark.readStream.schema(SIGHTING).parquet(f"{tmp_path}/in"), forget_ms=1)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(once=True).start().awaitTermination()
        got = [r.seq for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()]
        assert got == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
