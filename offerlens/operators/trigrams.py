"""Postings of trigrams for the store's text search: which products' names hold each three characters in a row (A-Z lower-cased).

``search`` gives the rows of ``history.search``: the trigrams of a pattern's literal parts (between ``%`` and ``_``) choose buckets of the postings, products
that have all of them are candidates, and the exact predicate decides. Ids, EANs and SKUs are postings too, as whole texts. A pattern without three literal
characters in a row can't be looked up; the products are scanned then.

Postings are distinct (text, product); a trigram that most names hold is no large group: a pattern's rarest trigram is looked up first and the others only
among its products. Null names, ids, EANs and SKUs have no postings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import _LOW, _UP, KEY, matches

BUCKETS, LOOKED_UP = 256, 8


def bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")


def postings(products: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(text, product_id, source, bucket) of every trigram of a name, and of every id, EAN and SKU (marked by ``=``)."""
    name = F.translate("name", _UP, _LOW)
    grams = F.when(F.length(name) >= 3, F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.concat(F.lit("~"), F.substring(name, i, 3))))
    exact = F.filter(F.transform(F.array("product_id", "ean", "sku"), lambda x: F.concat(F.lit("="), x)), lambda x: x.isNotNull())
    texts = F.array_distinct(F.concat(F.coalesce(grams, F.array().cast("array<string>")), exact))
    return products.select(*KEY, F.explode(texts).alias("text")).withColumn("bucket", bucket(F.col("text"), buckets))


def write(products: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Postings as a table by bucket, so that a look-up reads its buckets only; within one, files are sorted by text."""
    rows = postings(products, buckets)
    rows.repartition("bucket", F.pmod(F.xxhash64("text"), F.lit(4))).sortWithinPartitions("bucket", "text").write.mode("overwrite").partitionBy("bucket").parquet(path)


def grams_of(query: str) -> list[str]:
    """The trigrams that every matching name holds."""
    lower = query.translate(str.maketrans(_UP, _LOW))
    return sorted({part[i : i + 3] for part in re.split("[%_]", lower) for i in range(len(part) - 2)})


def _texts(rows: DataFrame, texts: list[str], buckets: int) -> DataFrame:
    numbers = rows.sparkSession.createDataFrame([(t,) for t in texts], "text string").select(bucket(F.col("text"), buckets).alias("b")).distinct().collect()
    return rows.filter(F.col("bucket").isin(*(r.b for r in numbers)) & F.col("text").isin(*texts))


def candidates(rows: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame | None:
    """Keys ``k`` (a struct) of products that may match; None where the pattern has no trigram."""
    grams = [f"~{g}" for g in grams_of(query)]
    if not grams:
        return None
    found = _texts(rows, grams, buckets)
    counts = {r.text: r["count"] for r in found.groupBy("text").count().collect()}  # at most as many rows as the pattern has trigrams
    named = F.struct(*KEY).alias("k")  # a null part of a key is equal to a null
    exact = _texts(rows, [f"={query}"], buckets).select(named)
    if len(counts) < len(grams):
        return exact.distinct()
    rarest, *others = sorted(grams, key=counts.get)[:LOOKED_UP]
    keys = found.filter(F.col("text") == rarest).select(named)
    for gram in others:
        keys = keys.join(found.filter(F.col("text") == gram).select(named), "k", "left_semi")
    return keys.unionByName(exact).distinct()


def search(products: DataFrame, rows: DataFrame, query: str, source: str | None = None, limit: int = 50, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``history.search(products, query, source, limit)``, by the postings ``rows``."""
    keys = candidates(rows, query, buckets)
    found = (products if keys is None else products.withColumn("k", F.struct(*KEY)).join(keys, "k", "left_semi").drop("k")).filter(matches(query))
    found = found if source is None else found.filter(F.col("source") == source)
    return found.orderBy(F.desc("last_seen"), *KEY).limit(limit)
