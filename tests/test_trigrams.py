"""Store search by postings against the scan."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from offerlens.operators import history as H
from offerlens.operators import trigrams

PRODUCT = "product_id string, source string, name string, ean string, sku string, last_seen timestamp"


def test_rows_of_the_scan(spark, tmp_path):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abÄäé1 _%B") for _ in range(draw.randrange(1, 9)))
    rows = [(str(n), draw.choice("xy"), None if n % 17 == 0 else word() + " " + word(), draw.choice([None, "123", "e%e"]), draw.choice([None, "abc", "ab"]), datetime(2024, 1, 1) + timedelta(minutes=draw.randrange(500))) for n in range(600)] + [(None, "x", "nobody abc", None, None, datetime(2024, 1, 1))]
    products = spark.createDataFrame(rows, PRODUCT).cache()
    trigrams.write(products, f"{tmp_path}/p", 16)
    stored = spark.read.parquet(f"{tmp_path}/p").cache()
    queries = ["", "%", "ab", "ABÄ", "abc", "123", "e%e", "nobody", "a_b", "1 %ab", "\\\\", "7", "zzz", "no%abc"]
    queries += ["".join(draw.choice([w, w[:4], "%", "_", w.upper()]) for w in (word() for _ in range(draw.randrange(1, 3)))) for _ in range(12)]
    looked_up = 0
    for q in queries:
        source = draw.choice([None, "x"])
        want = H.search(products, q, source, 1000).collect()
        assert trigrams.search(products, stored, q, source, 1000, buckets=16).collect() == want, q
        keys = trigrams.candidates(stored, q, 16)
        looked_up += keys is not None
    assert looked_up > 8 and trigrams.search(products, stored, "abc", None, 1, buckets=16).count() == 1


def test_a_look_up_reads_its_buckets(spark, tmp_path):
    names = spark.range(500).select(F.col("id").cast("string").alias("product_id"), F.lit("x").alias("source"), F.concat(F.lit("Thing "), "id").alias("name"), F.lit(None).cast("string").alias("ean"), F.lit(None).cast("string").alias("sku"), F.lit(datetime(2024, 1, 1)).alias("last_seen"))
    trigrams.write(names, f"{tmp_path}/p", 64)
    stored = spark.read.parquet(f"{tmp_path}/p")
    found = trigrams.search(names, stored, "thing 49", buckets=64)
    assert sorted(r.product_id for r in found.collect()) == ["49", *(str(n) for n in range(490, 500))]
    plan = spark._jvm.PythonSQLUtils.explainString(trigrams.candidates(stored, "thing 49", 64)._jdf.queryExecution(), "formatted")
    assert plan.count("PartitionFilters: [") >= 2 and "PushedFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1]
