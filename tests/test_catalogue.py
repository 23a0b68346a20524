"""The functions in the session's catalogue against the column functions."""

from pyspark.sql import functions as F

from offerlens.functions import catalogue, scalars
from offerlens.functions import text as T

PRICES = ["1 299,00 €", "459,90 €", "1.299,00", "899,-", " 79,95 €", "1299.00", "1,299.00", "59.99", "1.299", "2.499", "1,299", "459,9", "12,50", "", "ei hintaa", "€", ".", "1.", ",5", "1.2.3,4", None]
STOCKS = ["Varastossa", "Heti toimitukseen", "Tilapäisesti loppu", "Ei varastossa", "Out of stock", "Saatavilla toimittajalta", "", " ", "???", None]
NAMES = ["Samsung 990 Pro 1 TB", 'Näyttö 55" / 65”″ U80', "Straße ÅÄÖ é", "Intel Core i5-13600K", "55 tuuman 240 Hz x", "", "- -", None]


def test_sql_functions(spark):
    catalogue.register(spark)
    rows = spark.createDataFrame([(x,) for x in [*PRICES, *STOCKS, *NAMES]], "x string")
    got = rows.select("x", *(F.expr(f"offer_{f}(x)").alias(f) for f in ("price", "stock", "fold", "tokens"))).collect()
    x = F.col("x")
    want = rows.select("x", scalars.price(x).alias("price"), scalars.stock(x).alias("stock"), T.fold(x).alias("fold"), T.tokens(T.expand_inch_marks(T.fold(x))).alias("tokens")).collect()
    assert got == want and any(r.price == 1299.0 for r in got) and any(r.tokens == ["samsung", "990", "pro", "1tb"] for r in got)
    plan = spark._jvm.PythonSQLUtils.explainString(rows.select(F.expr("offer_tokens(x)"))._jdf.queryExecution(), "formatted")
    assert "EvalPython" not in plan


def test_table_functions(spark):
    catalogue.register(spark)
    card = '<article class="product-miniature" data-id-product="1"><h3 class="product-title"><a href="/p/1">Name</a></h3><span class="price">9,50 €</span></article>'
    pages = spark.createDataFrame([("datatronic", card * 2), ("datatronic", None), ("power", card), (None, card)], "source string, body string")
    got = spark.sql("SELECT source, rank, id, offer_price(price) AS price FROM {p} p, LATERAL page_cards(p.source, p.body)", p=pages).collect()
    assert [tuple(r) for r in got] == [("datatronic", 0, "1", 9.5), ("datatronic", 1, "1", 9.5)]
    page = '<h1>N</h1><script type="application/ld+json">{"@type":"Product","name":"G","gtin":"1"}</script>'
    pages = spark.createDataFrame([("gigantti", page), ("proshop", "<h1>N</h1>"), ("jimms", page), ("jimms", None), (None, page)], "source string, body string")
    got = spark.sql("SELECT source, name, ean FROM {p} p, LATERAL page_product(p.source, p.body)", p=pages).collect()
    assert [tuple(r) for r in got] == [("gigantti", "G", "1"), ("jimms", "N", None)]
