"""Scalar functions and text evidence on fixed vectors."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import scalars as S
from offerlens.functions import text as T
from offerlens.operators.identity import signature
from offerlens.sources import registry


def values(spark, rows, column, kind="string"):
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").select("i", column.alias("v")).orderBy("i").collect()
    return [r.v for r in got]


def test_prices(spark):
    cases = {"1 299,00 €": 1299.0, "459,90 €": 459.9, "1.299,00": 1299.0, "899,-": 899.0, "\xa079,95\xa0€": 79.95, "1299.00": 1299.0, "1,299.00": 1299.0, "59.99": 59.99, "1.299": 1299.0, "2.499": 2499.0, "1,299": 1299.0, "459,9": 459.9, "12,50": 12.5, "": None, "ei tiedossa": None, "€": None, "1.299.00": 1299.0}
    assert values(spark, list(cases), S.price(F.col("x"))) == list(cases.values())


def test_stock(spark):
    cases = {"Varastossa": True, "Heti toimitukseen": True, "Tilapäisesti loppu": False, "Ei varastossa": False, "Out of stock": False, "Saatavilla toimittajalta": False, "": None, "???": None, "unavailable": True}
    assert values(spark, list(cases), S.stock(F.col("x"))) == list(cases.values())


def test_urls(spark):
    hrefs = ["//cdn.x/a", "/a", "b", "https://y/z", " http://q "]
    assert values(spark, hrefs, S.absolute_url(F.lit("https://x.fi/"), F.col("x"))) == ["https://cdn.x/a", "https://x.fi/a", "https://x.fi/b", "https://y/z", "http://q"]
    assert values(spark, ["näytönohjain", "intel core i9", "a&b=c", "a*~"], S.url_encoded(F.col("x"))) == ["n%C3%A4yt%C3%B6nohjain", "intel+core+i9", "a%26b%3Dc", "a%2A~"]
    assert values(spark, ["  a \xa0\n b "], S.squeeze(F.col("x"))) == ["a b"]


@pytest.mark.parametrize(
    "source,url,found",
    [("datatronic", "https://x/1234-name.html", "1234"), ("datatronic", "https://x/?id_product=77&a=1", "77"), ("verkkokauppa", "https://x/fi/product/456/abc", "456"), ("power", "https://x/tv/p-1/y/p-789/", "789"), ("power", "https://x/p-12/p-x", None), ("jimms", "https://x/fi/Product/Show/99/n", "99"), ("multitronic", "https://x/fi/products/31/n", "31"), ("proshop", "https://x/A/B/3100?u=1", "3100"), ("gigantti", "https://x/product/a/1/", "1")],
)
def test_ids_of_urls(spark, source, url, found):
    assert values(spark, [url], S.url_id(F.lit(source), F.col("x"))) == [found]


def test_sources(spark):
    assert [registry.resolve(x) for x in ("jimms", "Jimms", "  JIMMS  ", "jimms.fi", "www.jimms.fi", "amazon", "")] == ["jimms"] * 5 + [None, None]
    assert registry.searchable(spark).count() == 6 and registry.sources(spark).count() == 7


def test_delays_and_backoff(spark):
    assert values(spark, [-5.0, 1e300, float("inf"), float("nan"), 2.5], S.delay_seconds(F.col("x")), "double") == [0.0, 3600.0, None, None, 2.5]
    assert values(spark, [1, 2, 3, 4, 20], S.backoff(F.col("x"), F.lit(None), F.lit(1.0), 1.0, 20.0), "int") == [1.0, 2.0, 4.0, 8.0, 20.0]
    assert values(spark, [2], S.backoff(F.col("x"), F.lit(None), F.lit(0.0), 1.0, 20.0), "int") == [1.0]
    assert values(spark, [7, 600], S.backoff(F.lit(1), F.col("x"), F.lit(0.0), 1.0, 20.0), "int") == [7.0, 20.0]
    assert S.retry_after_seconds("7", 0) == 7.0 and S.retry_after_seconds("soon", 0) is None and S.retry_after_seconds("Thu, 01 Jan 1970 00:00:09 GMT", 2) == 7.0
    assert S.pacing(-5) == 0 and S.pacing(1e300) == 3600 and S.pacing(float("nan")) is None


def test_gtin(spark):
    cases = {"0730143314350": "0730143314350", "730143314350": "0730143314350", "0730-1433-14350": "0730143314350", "5032037150354": "5032037150354", "4711081234567": None, "5656565656562": None, "0000000000000": None, "1111111111116": None, "12345": None, "": None, "SKU-ABC": None, "10730143314350": "0730143314350"}
    assert values(spark, list(cases), T.gtin("x")) == list(cases.values())


def test_tokens(spark):
    names = ["Samsung 990 Pro 1 TB", "Samsung 990 Pro 1TB", "Intel Core i5-13600K", '6.7" näyttö', "ß ÅÄÖ", "4.2 GHz"]
    assert values(spark, names, T.tokens(T.expand_inch_marks(T.fold(F.col("x"))))) == [["samsung", "990", "pro", "1tb"]] * 2 + [["intel", "core", "i5", "13600k"], ["6", "7inch", "naytto"], ["ss", "aao"], ["4", "2ghz"]]
    specs = ["1tt", "1tb", "1000gb", "1000gt", "512gb", "2tt", "240hz", "7800x3d", "55inch", "55tuuman", "55in"]
    assert values(spark, specs, F.expr(T.canonical_sql("x"))) == ["cap:1000gb"] * 4 + ["cap:512gb", "cap:2000gb", "240hz", None] + ["55inch"] * 3


def test_kinds(spark):
    cases = {"Seinäteline 32-55\"": "accessory", "TV stand": "accessory", "HDMI kaapeli 2m": "accessory", 'Kiinnike 32" - 55"': "accessory", "Tietokoneen kasauspalvelu": "service", 'Samsung 55" QLED': "device", "AMD Ryzen 7 7800X3D": "device", "standard TV": "device"}
    rows = spark.createDataFrame([(i, n, None, None, None) for i, n in enumerate(cases)], "i int, name string, ean string, sku string, brand string")
    assert [r.kind for r in signature(rows).orderBy("i").collect()] == list(cases.values())


def test_signature(spark):
    rows = spark.createDataFrame([("WD Black SN850X M.2 2280 1 Tt, ilman jäähdytyssiiliä", None, "WDS-100", "WD Öy!"), ("ASUS 27\" RTX 4070 Ti Super cooler", None, "x", None)], "name string, ean string, sku string, brand string")
    a, b = signature(rows).collect()
    assert (a.sku_key, a.brand_key, a.model_tokens, a.capacity_gb, a.qualifiers) == ("wds100", "wd oy", ["sn850x"], 1000, [])
    assert (b.sku_key, b.brand_key, b.model_tokens, b.screen_inches, b.qualifiers) == (None, "asus", ["4070"], 27, ["heatsink", "super", "ti"])


def test_timestamps_of_texts(spark):
    """What is no time is the epoch, as a stored text that can't be read."""
    texts = ["2024-05-01T10:00:00Z", "2024-05-01 10:00:00", "yesterday", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_timestamp(S.timestamp(F.col("t"))).alias("s")).collect()
    assert [r.s for r in got] == [1714557600, 1714557600, 0, 0, 0]
