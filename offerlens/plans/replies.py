"""Queries over captured replies: bodies of every retailer's kind are built from ``part``, written as captures and read back by the data source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_dir, spread
from ..functions import catalogue
from ..sources import captures, jsonld_native, parsers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LISTED = ("query_id", "source", "id", "name", "price_euro", "url", "image_url", "in_stock", "ean", "sku", "brand")
SEARCHED = ("datatronic", "verkkokauppa", "power", "jimms", "multitronic", "proshop")
PAGED = ("datatronic", "multitronic", "proshop", "gigantti", "jimms")


def _key() -> Column:
    return F.col("p_partkey")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _filled(template: str) -> Column:
    """``<k>``, ``<name>``, ``<euros>`` and ``<brand>`` of a template become the part's."""
    values = {"k": _key().cast("string"), "name": F.col("p_name"), "euros": F.floor("p_retailprice").cast("string"), "brand": F.col("p_brand")}
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


def _stock(yes: str, no: str, unknown: str) -> Column:
    return F.when(_key() % 3 == 0, yes).when(_key() % 3 == 1, no).otherwise(unknown)


def _search_bodies() -> dict[str, Column]:
    stock = lambda html: F.replace(_filled(html), F.lit("<stock>"), _stock("Varastossa", "Ei varastossa", "???"))
    item = '{"data":[{"id":"<k>","attributes":{"name":" <name> ","href":"/fi/product/<k>","price":{"current":<euros>},"images":[{"orig":"i<k>"}],"articles":[{"eans":[" ","e<k>"]}]},"relationships":{"brand":{"data":{"id":"b"}}}}],"included":[{"type":"brands","id":"b","attributes":{"name":"old"}},{"type":"brands","id":"b","attributes":{"name":"<brand>"}}]}'
    return {
        "datatronic": _filled('<article class="product-miniature" data-id-product="<k>"><a href="/p/<k>"><img data-src="//cdn.x/<k>.jpg"></a><h3 class="h3 product-title"><a href="/p/<k>"><name></a></h3><span class="price"><euros>,50 €</span></article><article class="product-miniature" data-id-product="9"><h3 class="product-title"><a href="/x">no price</a></h3></article>'),
        "verkkokauppa": _filled(item),
        "power": _filled('{"products":[{"productId":1,"title":" "},{"productId":<k>,"title":"<name>","price":<euros>,"manufacturerName":"<brand>","eanGtin12":" ","barcode":"b","productManufactorIdentity":"m<k>","webStockMeta":"InStock","productImage":{"basePath":"/m/","variants":[{"filename":"a","width":9},{"filename":"z","width":90}]}}]}'),
        "jimms": F.replace(_filled('{"IsError":<failed>,"ErrorMessage":"down","Products":[{"ProductID":<k>,"Code":"c<k>","VendorName":"Acme ","Name":"<name>","PriceTax":<euros>,"Uri":"/Product/<k>","ImageID":<k>,"ImageBaseSrc":"https://i/","ItemAvailability":1}]}'), F.lit("<failed>"), F.when(_key() % 7 == 0, "true").otherwise("false")),
        "multitronic": stock('<div class="item_wrapper" data-code="K<k>"><a class="pTitle" href="/fi/products/<k>/n"><b><name></b></a><div class="productDataEntry" data-price="<euros>.25" data-brand="<brand>"></div><div class="product_image"><img src="//cdn.x/<k>.png"></div><div class="product_stock"><span class="greytext"><stock></span></div></div>'),
        "proshop": F.replace(_filled('<ul><li class="site-productlist-item"><a class="site-product-link" href="/n/<k>"></a><h2 product-display-name><name></h2><span class="site-currency-lg"><euros> €</span><input name="productId" value="<k>"><span class="<icon>"></span><img src="/i/<k>.png"></li></ul>'), F.lit("<icon>"), _stock("site-icon-stock-in", "site-icon-stock-out", "none")),
    }


def _product_bodies() -> dict[str, Column]:
    ld = '<script type="application/ld+json">{"@type":"Product","name":"<name>","sku":"<k>","mpn":"m<k>","gtin13":"g<k>","brand":{"name":"<brand>"},"image":"/own.png","offers":{"price":"<euros>","availability":"https://schema.org/InStock"}}</script>'
    return {
        "datatronic": _filled('<h1 class="product_name"><name></h1><div class="current-price"><span class="price"><euros>,90 €</span></div><div class="product-availability">Ei varastossa</div><meta itemprop="gtin13" content="g<k>"><meta itemprop="sku" content="s<k>">'),
        "multitronic": _filled("<p>" + ld + "</p>"),
        "proshop": _filled(ld + '<meta property="og:image" content="/og/<k>.png">'),
        "gigantti": _filled(ld),
        "jimms": _filled('<h1><name></h1><span itemprop="price" content="<euros>.5"></span><link itemprop="availability" href="https://schema.org/InStock"><meta itemprop="gtin" content="g<k>"><meta itemprop="mpn" content="m<k>"><div itemprop="brand"><brand></div>'),
    }


def _kinds(of: dict[str, Column], sources: tuple[str, ...]) -> tuple[Column, Column]:
    """Source and body of a part: sources take turns."""
    turn = (_key() % len(sources)).cast("int")
    body = F.lit(None).cast("string")
    for n, s in enumerate(sources):
        body = F.when(turn == n, of[s]).otherwise(body)
    return F.element_at(F.array(*map(F.lit, sources)), turn + 1), body


def write_captures(spark: SparkSession, sf_dir: str) -> str:
    """A folder of captures made from ``part``: every eleventh reply failed, some bodies are broken or of another shape, and some lines are cut off."""
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    source, body = _kinds(_search_bodies(), SEARCHED)
    body = F.when(_key() % 13 == 0, "oops").when(_key() % 17 == 0, '{"data":"oops","products":{},"Products":7}').otherwise(body)
    page_source, page = _kinds(_product_bodies(), PAGED)
    stock = F.format_string('[{"pid":%d,"status":{"schema":"%s"}}]', _key(), F.when(_key() % 4 == 1, "instock").otherwise("OutOfStock"))
    reply = lambda s, kind, status, b: F.struct(s.alias("source"), F.lit(kind).alias("kind"), _key().cast("string").alias("request_key"), status.cast("int").alias("status"), b.alias("body"))
    failed = lambda code: F.when(_key() % 11 == 0, code).otherwise(200)
    replies = F.array(reply(source, "search", failed(503), body), reply(page_source, "product", F.when(_key() % 9 == 0, 404).otherwise(failed(500)), page))
    replies = F.when(_key() % 12 == 1, F.array_append(replies, reply(F.lit("verkkokauppa"), "availability", F.lit(200), stock))).otherwise(replies)
    lines = parts.select(F.explode(replies).alias("r"), (_key() % 19 == 0).alias("cut")).select("r.source", "r.kind", "cut", F.to_json(F.struct("r.request_key", "r.status", "r.body")).alias("value"))
    cut = lines.filter("cut AND kind = 'search'").select("source", "kind", F.lit('{"request_key": ').alias("value"))
    path = shared_dir(spark, "captures")
    lines.select("source", "kind", "value").unionByName(cut).write.partitionBy("source", "kind").text(path)
    return path


@query
def captured_search(spark, sf_dir):
    return parsers.search_listings(captures.Folder(spark, write_captures(spark, sf_dir))).select(*LISTED, "arrival")


@query
def captured_products(spark, sf_dir):
    return parsers.html_products(captures.Folder(spark, write_captures(spark, sf_dir))).select(*LISTED)


@query
def captured_errors(spark, sf_dir):
    return parsers.errors(captures.Folder(spark, write_captures(spark, sf_dir)))


@query
def page_cards(spark, sf_dir):
    """Cards of the HTML sources in SQL: a table function beside each page, prices and stock by SQL functions."""
    catalogue.register(spark)
    pages = captures.Folder(spark, write_captures(spark, sf_dir)).only(parsers.CARDS, ["search"])
    return spark.sql(
        "SELECT p.request_key AS query_id, p.source, c.rank, c.id, c.name, offer_tokens(c.name) AS tokens, offer_price(c.price) AS price_euro, c.url, offer_stock(c.stock) AS in_stock, c.stock_flag, c.sku, c.brand "
        "FROM {pages} p, LATERAL page_cards(p.source, p.body) c WHERE p.status < 400", pages=pages,
    ).withColumn("tokens", F.array_join("tokens", " "))


@query
def page_products(spark, sf_dir):
    """Product pages of the HTML sources in SQL, those of other sources too: what has no product gives no row."""
    catalogue.register(spark)
    pages = captures.Folder(spark, write_captures(spark, sf_dir)).only(None, ["product"])
    return spark.sql("SELECT p.request_key AS query_id, p.source, c.name, offer_fold(c.name) AS folded, offer_price(c.price) AS price_euro, offer_stock(c.stock) AS in_stock, c.availability, c.ean, c.sku, c.brand FROM {pages} p, LATERAL page_product(p.source, p.body) c", pages=pages)


@query
def jsonld_product(spark, sf_dir):
    """Scripts of five shapes: one product, a graph beside a broken script, an array with an aggregate offer, no product, and two products."""
    shapes = (
        '<p><script type="application/ld+json">{"@type":"Product","name":" <name> ","sku":"<k>","gtin":"g<k>","brand":"<brand>","image":["a<k>"],"url":"/own","offers":{"price":<euros>,"availability":"InStock"}}</script>',
        '<script type="application/ld+json">{oops</script><script id=x type=application/ld+json >{"@graph":[{"@type":"Organization","name":"shop"},{"@type":["Thing","PRODUCT"],"name":"<name>","mpn":<k>,"offers":[{"price":"1"},{"price":"<euros>","priceSpecification":[{"valueAddedTaxIncluded":true}],"url":"/o<k>"}]}]}</script>',
        "<SCRIPT TYPE='application/ld+json'>[{\"@type\":\"WebPage\"},[{\"@type\":\"product\",\"name\":\"<name>\",\"brand\":{\"name\":\"<brand>\"},\"image\":{\"contentUrl\":\"c\"},\"offers\":{\"@type\":\"AggregateOffer\",\"lowPrice\":1,\"offers\":[7,{\"price\":<euros>.5},{\"price\":2}]}}]]</script>",
        '<script type="application/ld+json">{"@type":"Thing","name":"<name>"}</script><script>{"@type":"Product","name":"no"}</script>',
        '<script type="application/ld+json">[{"@type":"Product","name":"<name>","gtin8":"8<k>","gtin12":true},{"@type":"Product","name":"second"}]</script>',
    )
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    pages = parts.select("p_partkey", F.element_at(F.array(*map(_filled, shapes)), (_key() % 5).cast("int") + 1).alias("html"))
    return jsonld_native.products(pages, "p_partkey", "html")


_PART = "p_partkey::VARCHAR AS query_id, '{0}' AS source, p_partkey::VARCHAR AS id, trim(p_name) AS name"
_ROW = "SELECT " + _PART + ", {1} AS price_euro, {2} AS url, {3} AS image_url, {4} AS in_stock, {5} AS ean, {6} AS sku, {7} AS brand"
_EUROS, _STOCK = "floor(p_retailprice)::DOUBLE", "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"
_FOUND = [
    (0, "datatronic", f"{_EUROS} + 0.5", "'https://www.datatronic.fi/p/' || p_partkey", "'https://cdn.x/' || p_partkey || '.jpg'", "NULL::BOOLEAN", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR"),
    (1, "verkkokauppa", _EUROS, "'https://www.verkkokauppa.com/fi/product/' || p_partkey", "'i' || p_partkey", "CASE WHEN p_partkey % 12 = 1 THEN p_partkey % 4 = 1 END", "'e' || p_partkey", "NULL", "p_brand"),
    (2, "power", _EUROS, "'https://www.power.fi/p-' || p_partkey || '/'", "'https://media.power-cdn.net/m/z'", "true", "NULL", "'m' || p_partkey", "p_brand"),
    (3, "jimms", _EUROS, "'https://www.jimms.fi/fi/Product/' || p_partkey", "'https://i/' || p_partkey || '-ig400gg.jpg'", "true", "NULL", "'c' || p_partkey", "'Acme'"),
    (4, "multitronic", f"{_EUROS} + 0.25", "'https://www.multitronic.fi/fi/products/' || p_partkey || '/n'", "'https://cdn.x/' || p_partkey || '.png'", _STOCK, "NULL", "'K' || p_partkey", "p_brand"),
    (5, "proshop", _EUROS, "'https://www.proshop.fi/n/' || p_partkey", "'https://www.proshop.fi/i/' || p_partkey || '.png'", _STOCK, "NULL", "NULL", "NULL"),
]
_SOUND = "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0"
_NAME = {"jimms": "'Acme ' || trim(p_name)"}
SQL["captured_search"] = " UNION ALL ".join(
    _ROW.format(*row[1:]).replace("trim(p_name) AS name", f"{_NAME.get(row[1], 'trim(p_name)')} AS name") + f", {row[0] * 1_000_000 + (1 if row[1] == 'power' else 0)}::BIGINT AS arrival FROM part WHERE p_partkey % 6 = {row[0]} AND {_SOUND}" + (" AND p_partkey % 7 <> 0" if row[1] == "jimms" else "")
    for row in _FOUND
)
_LD = ("'g' || p_partkey", "'m' || p_partkey", "p_brand")
_PAGES = [
    (0, "datatronic", f"{_EUROS} + 0.9", "'https://www.datatronic.fi/' || p_partkey", "NULL::VARCHAR", "false", "'g' || p_partkey", "'s' || p_partkey", "NULL::VARCHAR"),
    (1, "multitronic", _EUROS, "'https://www.multitronic.fi/fi/products/' || p_partkey", "'https://www.multitronic.fi/own.png'", "true", *_LD),
    (2, "proshop", _EUROS, "'https://www.proshop.fi/' || p_partkey", "'https://www.proshop.fi/og/' || p_partkey || '.png'", "true", *_LD),
    (3, "gigantti", _EUROS, "'https://www.gigantti.fi/product/' || p_partkey", "'https://www.gigantti.fi/own.png'", "true", *_LD),
    (4, "jimms", f"{_EUROS} + 0.5", "'https://www.jimms.fi/fi/Product/Show/' || p_partkey", "NULL", "true", *_LD),
]
SQL["captured_products"] = " UNION ALL ".join(_ROW.format(*row[1:]) + f" FROM part WHERE p_partkey % 5 = {row[0]} AND p_partkey % 9 <> 0 AND p_partkey % 11 <> 0" for row in _PAGES)
_SEARCH_SOURCE = "['" + "', '".join(SEARCHED) + "'][p_partkey % 6 + 1]"
SQL["captured_errors"] = f"""
WITH s AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS query_id, {_SEARCH_SOURCE} AS source FROM part),
e AS (SELECT query_id, source, CASE WHEN k % 11 = 0 THEN 'HTTP status 503' WHEN source NOT IN ('verkkokauppa', 'power', 'jimms') THEN NULL WHEN k % 13 = 0 THEN 'reply is no JSON' WHEN k % 17 = 0 THEN 'reply has another shape'
    WHEN source = 'jimms' AND k % 7 = 0 THEN 'down' END AS error, k % 11 = 0 AS retryable FROM s
  UNION ALL SELECT p_partkey::VARCHAR, ['{"', '".join(PAGED)}'][p_partkey % 5 + 1], CASE WHEN p_partkey % 11 = 0 AND p_partkey % 9 <> 0 THEN 'HTTP status 500' END, true FROM part
  UNION ALL SELECT NULL, source, 'broken line: Expecting value: line 2 column 1 (char 17)', false FROM s WHERE k % 19 = 0)
SELECT query_id, source, error, retryable FROM e WHERE error IS NOT NULL"""
_FLOOR = "floor(p_retailprice)::BIGINT"
SQL["jsonld_product"] = f"""SELECT p_partkey, trim(p_name) AS name, CASE m WHEN 0 THEN p_partkey::VARCHAR END AS sku, CASE m WHEN 1 THEN p_partkey::VARCHAR END AS mpn, CASE m WHEN 0 THEN 'g' || p_partkey WHEN 4 THEN '8' || p_partkey END AS gtin,
  CASE WHEN m IN (0, 2) THEN p_brand END AS brand, CASE m WHEN 0 THEN 'a' || p_partkey WHEN 2 THEN 'c' END AS image, CASE m WHEN 0 THEN '/own' WHEN 1 THEN '/o' || p_partkey END AS url,
  CASE WHEN m IN (0, 1) THEN {_FLOOR}::VARCHAR WHEN m = 2 THEN {_FLOOR} || '.5' END AS price, CASE m WHEN 0 THEN 'InStock' END AS availability FROM (SELECT *, p_partkey % 5 AS m FROM part) WHERE m != 3"""
SQL["page_cards"] = f"""SELECT p_partkey::VARCHAR AS query_id, source, 0::INTEGER AS rank, CASE WHEN source != 'multitronic' THEN p_partkey::VARCHAR END AS id, trim(p_name) AS name, array_to_string(string_split(trim(p_name), ' '), ' ') AS tokens,
  {_EUROS} + CASE source WHEN 'datatronic' THEN 0.5 WHEN 'multitronic' THEN 0.25 ELSE 0 END AS price_euro, CASE source WHEN 'datatronic' THEN '/p/' || p_partkey WHEN 'multitronic' THEN '/fi/products/' || p_partkey || '/n' ELSE '/n/' || p_partkey END AS url,
  CASE WHEN source = 'multitronic' THEN {_STOCK} END AS in_stock, CASE WHEN source = 'proshop' THEN CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END END AS stock_flag, CASE WHEN source = 'multitronic' THEN 'K' || p_partkey END AS sku,
  CASE WHEN source = 'multitronic' THEN p_brand END AS brand FROM (SELECT *, {_SEARCH_SOURCE} AS source FROM part) WHERE source IN ('datatronic', 'multitronic', 'proshop') AND {_SOUND}"""
SQL["page_products"] = f"""SELECT p_partkey::VARCHAR AS query_id, source, trim(p_name) AS name, lower(trim(p_name)) AS folded, {_EUROS} + CASE source WHEN 'datatronic' THEN 0.9 WHEN 'jimms' THEN 0.5 ELSE 0 END AS price_euro,
  CASE WHEN source = 'datatronic' THEN false END AS in_stock, CASE WHEN source != 'datatronic' THEN 'https://schema.org/InStock' END AS availability, 'g' || p_partkey AS ean, CASE WHEN source = 'datatronic' THEN 's' ELSE 'm' END || p_partkey AS sku,
  CASE WHEN source != 'datatronic' THEN p_brand END AS brand FROM (SELECT *, ['{"', '".join(PAGED)}'][p_partkey % 5 + 1] AS source FROM part)"""
