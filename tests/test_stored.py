"""Bucketed state: reports without a shuffle, upserts that shuffle the batch only, versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlens.operators import alerts as A
from offerlens.operators import history as H
from offerlens.operators.stored import Stored

SEEN = "product_id string, source string, recorded_at timestamp, seq long, name string, url string, image_url string, price_euro double, in_stock boolean, ean string, sku string, brand string"
ACTION = "action string, product_id string, source string, target_price double, acted_at timestamp, seq long"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def batches(draw, n):
    seq, out = 0, []
    for _ in range(n):
        some = []
        for _ in range(150):
            seq += 1
            fact = lambda: draw.choice([None, None, f"f{seq}"])
            some.append((draw.choice([*"abcdefgh", None]), draw.choice("xy"), datetime(2024, 1, 1) + timedelta(minutes=seq), seq, f"n{seq}", f"u{seq}", fact(), draw.choice([1.0, 2.0, 3.0]), True, fact(), fact(), fact()))
        out.append(some)
    return out


def told(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_upserts_by_batches(spark, tmp_path, no_broadcast):
    some = batches(random.Random(2), 3)
    store = Stored(spark, f"file://{tmp_path}/s", "upserts", buckets=4)
    assert store.open("products") is None
    for b in some:
        store.upsert(spark.createDataFrame(b, SEEN))
    want = {(r.product_id, r.source): r for r in H.products(spark.createDataFrame([r for b in some for r in b], SEEN)).collect()}
    assert {(r.product_id, r.source): r for r in store.open("products").collect()} == want
    for version in (1, 2, 3):
        spark.sql(f"DROP TABLE IF EXISTS upserts_products_v{version}")
    again = Stored(spark, f"file://{tmp_path}/s", "upserts", buckets=4).open("products")  # as a new session finds it
    assert again.count() == len(want) and "Bucketed: true" in told(spark, again.groupBy(*H.KEY).count())


def test_report_without_a_shuffle(spark, tmp_path, no_broadcast):
    draw = random.Random(3)
    (seen,) = batches(draw, 1)
    seen = spark.createDataFrame([r for r in seen if r[0]], SEEN)
    actions = spark.createDataFrame([(draw.choice(["alert", "alert", "track", "unalert"]), draw.choice("abcdefgh"), draw.choice("xy"), draw.choice([1.5, 2.5]), datetime(2024, 1, 1) + timedelta(minutes=n), n) for n in range(80)], ACTION)
    latest = H.latest(H.changes(seen))
    store = Stored(spark, f"file://{tmp_path}/s", "report", buckets=4)
    for name, rows in (("actions", actions), ("products", H.products(seen)), ("latest", latest)):
        store.write(name, rows)
    report = store.report()
    want = A.report(A.alerts(actions), H.products(seen), latest).collect()
    assert report.collect() == want and want
    plan = told(spark, report)
    assert "hashpartitioning" not in plan and "BroadcastExchange" not in plan and plan.count("Bucketed: true") >= 3
    tracked = A.tracked_report(A.tracked(store.open("actions")), store.open("products"), store.open("latest"))
    assert "hashpartitioning" not in told(spark, tracked)


def test_a_version_that_broke_off_is_passed_over(spark, tmp_path):
    store = Stored(spark, f"file://{tmp_path}/s", "broken", buckets=2)
    rows = spark.range(10).select(F.col("id").cast("string").alias("product_id"), F.lit("x").alias("source"))
    store.write("latest", rows)
    store.write("latest", rows.limit(3))
    (tmp_path / "s" / "latest" / "v2" / "_SUCCESS").unlink()
    assert store.open("latest").count() == 10
    assert store.write("latest", rows.limit(4)).count() == 4 and store.open("latest").count() == 4
