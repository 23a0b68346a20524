"""Replies of the retailers (captured payloads) as listings.

JSON replies are read by ``from_json`` and explode; HTML needs a tree and is read in Arrow batches, a row in, its cards out,
as raw text: prices, stock phrases and URLs become values in native expressions afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import jsonld
from .captures import Folder
from .markup import Node, parse
from .registry import ORIGIN, PAGE_CAP, WITHOUT_PAGES

RAW = ("id", "name", "price", "url", "image", "stock", "stock_flag", "availability", "ean", "sku", "brand")
RAW_SCHEMA = "query_id string, source string, rank int, " + ", ".join(f"{c} string" for c in RAW)


def _attr(node: Node | None, *names: str) -> str | None:
    return next((v for v in (node.get(n) for n in names) if v is not None), None) if node is not None else None


def _text(node: Node | None) -> str | None:
    return node.squeezed() or None if node is not None else None


def datatronic_cards(top: Node) -> Iterator[dict]:
    for card in top.all(".product-miniature, .js-product-miniature, article[data-id-product]"):
        name = _text(card.first(".product-title a, .product-name a, .h3.product-title a, .product-description a"))
        price, href = card.first(".price, .product-price, .product-price-and-shipping .price"), _attr(card.first("a[href]"), "href")
        if name and len(name.encode()) >= 3 and price is not None and href is not None:
            image = card.first("img[src], img[data-src], img[data-full-size-image-url]")
            yield {"id": card.get("data-id-product"), "name": name, "price": price.text(), "url": href, "image": _attr(image, "src", "data-src", "data-full-size-image-url")}


def multitronic_cards(top: Node) -> Iterator[dict]:
    for card in top.all("div.item_wrapper"):
        title, data = card.first("a.pTitle"), card.first(".productDataEntry")
        if title is not None and title.get("href") and _text(title) and data is not None:
            code = data.get("data-code") if data.get("data-code") is not None else card.get("data-code")
            stock = card.first(".product_stock .greytext")
            yield {
                "name": _text(title), "price": data.get("data-price"), "url": title.get("href"), "image": _attr(card.first(".product_image img"), "src"),
                "stock": stock.text() if stock is not None else None, "sku": code if code and code.strip() else None, "brand": (data.get("data-brand") or "").strip() and data.get("data-brand") or None,
            }


def proshop_cards(top: Node) -> Iterator[dict]:
    for card in top.all("li.site-productlist-item"):
        href, name, price = _attr(card.first("a.site-product-link"), "href"), _text(card.first("h2[product-display-name]")), card.first("span.site-currency-lg")
        if href is None or not name or price is None:
            continue
        number = (_attr(card.first('input[name="productId"]'), "value") or "").strip() or None
        classes = next((c for n in card.all("span[class], i[class], div[class]") if "site-icon-stock" in (c := n.get("class") or "")), "")  # the first icon
        flag = "true" if "site-icon-stock-in" in classes else "false" if "site-icon-stock-comming" in classes or "site-icon-stock-out" in classes else None
        stock = card.first(".site-stock-text")
        yield {"id": number, "name": name, "price": price.text(), "url": href, "image": _attr(card.first("img"), "src", "data-src"), "stock": stock.text() if stock is not None else None, "stock_flag": flag}


CARDS: dict[str, Callable[[Node], Iterator[dict]]] = {"datatronic": datatronic_cards, "multitronic": multitronic_cards, "proshop": proshop_cards}


def _microdata(top: Node, prop: str, *attributes: str) -> str | None:
    node = top.first(f'[itemprop="{prop}"]')
    if node is None:
        return None
    for a in attributes:
        if (value := " ".join((node.get(a) or "").split())):
            return value
    return _text(node)


def product_page(source: str, top: Node) -> dict | None:
    """The raw fields of a product page: JSON-LD first, then what the retailer's own markup has."""
    ld = jsonld.find(top) if source != "jimms" else None
    found = {"name": None} if ld is None else {"name": ld["name"], "price": ld["price"], "url": ld["url"], "image": ld["image"], "availability": ld["availability"], "ean": ld["gtin"], "sku": ld["mpn"], "brand": ld["brand"]}
    if ld is not None and source in ("proshop", "gigantti"):
        found["id"] = ld["sku"]
    if source == "datatronic":
        price = top.first(".current-price .price, .product-price .price, .product-price")
        stock = top.first(".product-availability, .stock, #availability_value, .availability")
        own = {
            "name": _text(top.first('h1.product_name, h1[itemprop="name"], h1, .h1.product-title, .product-name')) or _microdata(top, "name", "content"),
            "price": _microdata(top, "price", "content") or (price.text() if price is not None else None),
            "stock": stock.text() if stock is not None else None,
            "image": _microdata(top, "image", "content") or _attr(top.first(".product-cover img, .js-qv-product-cover"), "src"),
            "ean": _microdata(top, "gtin13", "content"), "sku": _microdata(top, "sku", "content"), "brand": _microdata(top, "brand", "content"),
        }
        found = {k: found.get(k) or v for k, v in (own | found).items() for v in [own.get(k)]}
    elif source == "jimms":
        found = {
            "name": _text(top.first("h1")) or _microdata(top, "name", "content"), "price": _microdata(top, "price", "content"), "availability": _microdata(top, "availability", "content", "href"),
            "image": _microdata(top, "image", "content", "src"), "ean": _microdata(top, "gtin13", "content") or _microdata(top, "gtin", "content"), "sku": _microdata(top, "mpn", "content"), "brand": _microdata(top, "brand", "content"),
        }
    elif source == "proshop" and ld is not None:
        found["image"] = _attr(top.first('meta[property="og:image"]'), "content")  # that of the JSON-LD has no host
    return found if found.get("name") else None


def _read(payloads: DataFrame, rows_of: Callable[..., Iterator[dict]], with_url: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, source, body, url in zip(batch["request_key"], batch["source"], batch["body"], batch["final_url"], strict=True):
                for rank, row in enumerate(rows_of(source, query, body or "", *([url or None] if with_url else []))):
                    out.append((query, source, rank, *(row.get(c) for c in RAW)))
            yield pd.DataFrame(out, columns=["query_id", "source", "rank", *RAW]).astype(object)

    return payloads.select("request_key", "source", "body", "final_url").mapInPandas(run, RAW_SCHEMA)


def _valued(raw: DataFrame, price_needed: bool) -> DataFrame:
    """Raw fields as listing columns; rows without id, name (or price, if needed) go."""
    origin = F.element_at(F.create_map(*[F.lit(x) for kv in ORIGIN.items() for x in kv]), F.col("source"))
    stock = F.coalesce(F.col("stock_flag").try_cast("boolean"), F.when(F.col("availability").isNotNull(), S.schema_availability(F.col("availability"))), S.stock(F.col("stock")))
    rows = raw.select(
        "query_id", "source", "rank",
        F.coalesce(F.col("id"), S.url_id(F.col("source"), F.col("url"))).alias("id"),
        S.squeeze(F.col("name")).alias("name"),
        S.price(F.col("price")).alias("price_euro"),
        S.absolute_url(origin, F.col("url")).alias("url"),
        S.absolute_url(origin, F.col("image")).alias("image_url"),
        stock.alias("in_stock"), "ean", "sku", "brand",
    )
    rows = rows.filter(F.col("id").isNotNull() & (F.col("name") != ""))
    return rows.filter("price_euro IS NOT NULL") if price_needed else rows.withColumn("price_euro", F.coalesce("price_euro", F.lit(0.0)))


def html_search(payloads: DataFrame | Folder) -> DataFrame:
    """Listings of search and category replies in HTML."""
    return _valued(_read(_of(payloads, CARDS, LISTS).filter(_delivered()), lambda source, _, body: CARDS[source](parse(body))), True)


def html_products(payloads: DataFrame | Folder) -> DataFrame:
    """Listings of product pages in HTML; ``request_key`` is the product's id unless the page states another. An unknown price is 0.

    Datatronic's and Proshop's pages are listed under the URL that the request ended at.
    """

    def rows(source: str, key: str, body: str, final: str | None) -> Iterator[dict]:
        page = product_page(source, parse(body))
        if page is not None:
            number = page.get("id") or key
            fallback = {"multitronic": f"/fi/products/{key}", "jimms": f"/fi/Product/Show/{key}", "gigantti": f"/product/{number}"}.get(source, f"/{key}")
            canonical = final if source in ("datatronic", "proshop") else None
            yield page | {"id": number, "url": canonical or page.get("url") or fallback}

    pages = _of(payloads, ("datatronic", "multitronic", "proshop", "gigantti", "jimms"), ("product",)).filter(_delivered())
    return _valued(_read(pages, rows, True), False)


def _of(payloads: DataFrame | Folder, sources: Iterable[str] | None, kinds: Iterable[str] | None) -> DataFrame:
    """Payloads of some sources and kinds (None: all), of a frame or a folder of captures."""
    if isinstance(payloads, Folder):
        return payloads.only(sources, kinds)
    for name, values in (("source", sources), ("kind", kinds)):
        payloads = payloads if values is None else payloads.filter(F.col(name).isin(*values))
    return payloads


def _delivered() -> Column:
    return ~S.bot_challenge(F.col("status"), F.col("headers")) & (F.coalesce("status", F.lit(200)) < 400)


def _json(payloads: DataFrame | Folder, source: str, kinds: str | tuple[str, ...], schema: str) -> DataFrame:
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    return _of(payloads, (source,), kinds).filter(_delivered()).select("request_key", F.from_json("body", schema).alias("b"))


def _shaped(source: str) -> Column:
    """The body of a reply that lists products; null if it's no JSON, of another shape, or lacks what its retailer always states."""
    b = F.from_json("body", f"{SHAPES[source]}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    sound = b["_bad"].isNull()
    if source == "verkkokauppa":
        lacks = lambda items, *names: F.exists(F.coalesce(items, F.array()), lambda x: F.greatest(*(x[n].isNull() for n in names)))
        sound &= ~lacks(b["data"], "id", "attributes") & ~lacks(b["included"], "type", "id", "attributes")
    return F.when(sound, b)


def _listed(payloads: DataFrame | Folder, source: str) -> DataFrame:
    """(request_key, b) of the search and category replies that arrived and are sound."""
    replies = _of(payloads, (source,), LISTS).filter(_delivered())
    return replies.select("request_key", _shaped(source).alias("b")).filter("b IS NOT NULL")


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


#: Kinds of replies that list products.
LISTS = ("search", "category")
VERKKOKAUPPA_PRODUCT = (
    "array<struct<pid:string,name:struct<fi:string,en:string>,href:struct<fi:string,en:string>,price:struct<current:double>,eans:array<string>,mpns:array<string>,"
    "brand:struct<name:string>,images:string>>"
)
VERKKOKAUPPA = (
    "data array<struct<id:string,attributes:struct<name:string,href:string,price:struct<current:double>,images:array<struct<orig:string>>,articles:array<struct<eans:array<string>>>>,"
    "relationships:struct<brand:struct<data:struct<id:string>>>>>, included array<struct<type:string,id:string,attributes:struct<name:string>>>"
)
POWER_ROW = (
    "struct<productId:bigint,title:string,url:string,price:double,manufacturerName:string,eanGtin12:string,barcode:string,productManufactorIdentity:string,webStockMeta:string,"
    "productImage:struct<basePath:string,variants:array<struct<filename:string,width:int>>>>"
)
JIMMS = (
    "IsError boolean, ErrorMessage string, Products array<struct<ProductID:bigint,Code:string,VendorName:string,Name:string,PriceTax:double,Uri:string,"
    "ImageID:bigint,ImageBaseSrc:string,ItemAvailability:int>>"
)
SHAPES = {"verkkokauppa": VERKKOKAUPPA, "power": f"products array<{POWER_ROW}>", "jimms": JIMMS}


def verkkokauppa_search(payloads: DataFrame | Folder) -> DataFrame:
    """Search replies; the brand comes from the reply's own side table (the last one named of a repeated id), stock from ``availability`` replies."""
    b = _listed(payloads, "verkkokauppa")
    items = b.select("request_key", "b.included", F.posexplode("b.data").alias("rank", "x"))
    brand = F.get(F.reverse(F.filter("included", lambda i: (i["type"] == "brands") & (i["id"] == F.col("x.relationships.brand.data.id")) & i["attributes"]["name"].isNotNull())), F.lit(0))["attributes"]["name"]
    eans = F.flatten(F.transform(F.coalesce("x.attributes.articles", F.array()), lambda a: F.coalesce(a["eans"], F.array())))
    schemas = _json(payloads, "verkkokauppa", "availability", "array<struct<pid:bigint,status:struct<schema:string>>>").select("request_key", F.posexplode("b").alias("at", "a"))
    last = F.max_by(F.lower("a.status.schema") == "instock", F.struct("request_key", "at"))
    stock = schemas.groupBy(F.col("a.pid").cast("string").alias("pid")).agg(last.alias("in_stock"))
    origin, name = ORIGIN["verkkokauppa"], F.trim("x.attributes.name")
    rows = items.filter(F.col("x.id").isNotNull() & (name != "")).select(
        F.col("request_key").alias("query_id"), F.lit("verkkokauppa").alias("source"), "rank", F.col("x.id").alias("id"), name.alias("name"),
        F.coalesce("x.attributes.price.current", F.lit(0.0)).alias("price_euro"),
        S.absolute_url(F.lit(origin), F.coalesce("x.attributes.href", F.concat(F.lit("/fi/product/"), "x.id"))).alias("url"),
        F.get("x.attributes.images", F.lit(0))["orig"].alias("image_url"), F.get(F.filter(eans, lambda e: F.trim(e) != ""), F.lit(0)).alias("ean"),
        F.lit(None).cast("string").alias("sku"), brand.alias("brand"),
    )
    return rows.join(stock, rows["id"] == stock["pid"], "left").drop("pid")


def _first_filled(texts: Column) -> Column:
    return F.get(F.filter(texts, lambda t: F.trim(t) != ""), F.lit(0))


def largest_image(images: Column) -> Column:
    """Images as JSON text: of an object by widths the widest, of a list the first, else the text itself."""
    widths = F.filter(F.map_entries(F.from_json(images, "map<string,string>")), lambda e: e["key"].try_cast("int").isNotNull() & e["value"].isNotNull())
    widest = F.array_max(F.transform(widths, lambda e: F.struct(e["key"].cast("int").alias("w"), e["value"].alias("v"))))["v"]
    kind = F.substring(F.ltrim(images), 1, 1)
    return F.when(kind == "{", widest).when(kind == "[", F.get(F.from_json(images, "array<string>"), F.lit(0))).otherwise(images)


def verkkokauppa_products(payloads: DataFrame | Folder) -> DataFrame:
    """Product replies: the first element, its Finnish name and link before the English ones. Stock is not in them."""
    x, origin = F.col("x"), ORIGIN["verkkokauppa"]
    items = _json(payloads, "verkkokauppa", "product", VERKKOKAUPPA_PRODUCT).select("request_key", F.get("b", F.lit(0)).alias("x"))
    name, href = (F.coalesce(x[c]["fi"], x[c]["en"]) for c in ("name", "href"))
    return items.filter(x["pid"].isNotNull() & ~x["pid"].rlike(r"^[\[{]|^(true|false)$") & name.isNotNull()).select(
        F.col("request_key").alias("query_id"), F.lit("verkkokauppa").alias("source"), F.lit(0).alias("rank"), x["pid"].alias("id"), name.alias("name"),
        F.coalesce(x["price"]["current"], F.lit(0.0)).alias("price_euro"), S.absolute_url(F.lit(origin), F.coalesce(href, F.concat(F.lit("/fi/product/"), x["pid"]))).alias("url"),
        largest_image(x["images"]).alias("image_url"), F.lit(None).cast("boolean").alias("in_stock"), _first_filled(x["eans"]).alias("ean"), _first_filled(x["mpns"]).alias("sku"), x["brand"]["name"].alias("brand"),
    )


def _power_listing(items: DataFrame) -> DataFrame:
    """(request_key, rank, x: an element of a reply) as listings."""
    x, origin = F.col("x"), ORIGIN["power"]
    images = F.filter(x["productImage"]["variants"], lambda v: v["filename"].isNotNull())
    widest = F.array_max(F.transform(images, lambda v, i: F.struct(F.coalesce(v["width"], F.lit(0)).alias("w"), i.alias("i"), v["filename"].alias("f"))))["f"]
    return items.filter(x["productId"].isNotNull() & (F.trim(x["title"]) != "")).select(
        F.col("request_key").alias("query_id"), F.lit("power").alias("source"), "rank", x["productId"].cast("string").alias("id"), F.trim(x["title"]).alias("name"),
        F.coalesce(x["price"], F.lit(0.0)).alias("price_euro"), S.absolute_url(F.lit(origin), F.coalesce(x["url"], F.concat(F.lit("/p-"), x["productId"], F.lit("/")))).alias("url"),
        S.absolute_url(F.lit("https://media.power-cdn.net"), F.concat(F.regexp_replace(x["productImage"]["basePath"], "/+$", ""), F.lit("/"), widest)).alias("image_url"),
        (F.lower(x["webStockMeta"]) == "instock").alias("in_stock"), _filled(F.coalesce(x["eanGtin12"], x["barcode"])).alias("ean"), _filled(x["productManufactorIdentity"]).alias("sku"), _filled(x["manufacturerName"]).alias("brand"),
    )


def power_search(payloads: DataFrame | Folder) -> DataFrame:
    return _power_listing(_listed(payloads, "power").select("request_key", F.posexplode("b.products").alias("rank", "x")))


def power_products(payloads: DataFrame | Folder) -> DataFrame:
    """Product replies: the first element that has an id and a title."""
    named = lambda x: x["productId"].isNotNull() & (F.trim(x["title"]) != "")
    replies = _json(payloads, "power", "product", f"array<{POWER_ROW}>")
    return _power_listing(replies.select("request_key", F.lit(0).alias("rank"), F.get(F.filter("b", named), F.lit(0)).alias("x")))


def product_listings(payloads: DataFrame | Folder) -> DataFrame:
    """Listings of all sources' product replies; what was not found (404, 410) or failed has none."""
    return html_products(payloads).unionByName(verkkokauppa_products(payloads)).unionByName(power_products(payloads))


def jimms_search(payloads: DataFrame | Folder) -> DataFrame:
    """Replies that state an error give no rows here but a row in ``errors``."""
    x, origin = F.col("x"), ORIGIN["jimms"]
    items = _listed(payloads, "jimms").filter("NOT coalesce(b.IsError, false)").select("request_key", F.posexplode("b.Products").alias("rank", "x"))
    vendor = F.nullif(F.trim(x["VendorName"]), F.lit(""))
    url = F.coalesce(F.concat(F.lit("/fi/"), F.regexp_replace(F.trim(_filled(x["Uri"])), "^/+", "")), F.concat(F.lit("/fi/Product/Show/"), x["ProductID"]))
    image = S.absolute_url(F.lit(origin), F.concat(_filled(x["ImageBaseSrc"]), x["ImageID"], F.lit("-ig400gg.jpg")))
    return items.filter(x["ProductID"].isNotNull() & (F.trim(x["Name"]) != "")).select(
        F.col("request_key").alias("query_id"), F.lit("jimms").alias("source"), "rank", x["ProductID"].cast("string").alias("id"), S.with_vendor(vendor, F.trim(x["Name"])).alias("name"),
        F.coalesce(x["PriceTax"], F.lit(0.0)).alias("price_euro"), F.concat(F.lit(origin), url).alias("url"), image.alias("image_url"),
        S.availability_code(x["ItemAvailability"]).alias("in_stock"), F.lit(None).cast("string").alias("ean"), _filled(x["Code"]).alias("sku"), vendor.alias("brand"),
    )


def search_listings(payloads: DataFrame | Folder, limit: int = 10) -> DataFrame:
    """All sources' search replies as one table, the first ``limit`` of each reply; ``arrival`` is the source's rank, then the reply's order."""
    from ..operators.history import first_by_source

    order = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(ORIGIN) for x in (s, i)]), F.col("source"))
    together = verkkokauppa_search(payloads).unionByName(power_search(payloads)).unionByName(jimms_search(payloads)).unionByName(html_search(payloads))
    ranked = together.withColumn("arrival", order.cast("long") * 1_000_000 + F.col("rank")).drop("rank")
    return first_by_source(ranked, limit, caps=PAGE_CAP)


def errors(payloads: DataFrame | Folder) -> DataFrame:
    """(query_id, source, error, retryable): replies that failed or couldn't be read, are not of their kind's shape, state an error, or are of a source without search.

    A reply has either listings or an error, and one source's errors leave the others' listings alone. Replies on stock only never fail: stock is unknown then.
    """
    payloads = _of(payloads, None, None)
    stated = F.from_json("body", "IsError boolean, ErrorMessage string")
    lists, gone = F.col("kind").isin(*LISTS), F.col("status").isin(404, 410) & ((F.col("source") != "gigantti") | (F.col("status") == 404))
    error = F.when(F.col("error").isNotNull(), F.col("error")) if "error" in payloads.columns else F.when(F.lit(False), "")
    error = (
        error.when(F.col("kind") == "availability", F.lit(None))
        .when((F.col("kind") == "search") & (F.col("source") == "gigantti"), "search is not supported")
        .when(S.bot_challenge(F.col("status"), F.col("headers")), "blocked by a bot challenge")
        .when((F.col("kind") == "product") & gone, F.lit(None))  # not found is an answer
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP status "), "status"))
    )
    for source in SHAPES:
        of = lists & (F.col("source") == source)
        error = error.when(of & F.try_parse_json("body").isNull(), "reply is no JSON")
        if source == "jimms":
            error = error.when(of & stated["IsError"], F.coalesce(stated["ErrorMessage"], F.lit("error")))
        error = error.when(of & _shaped(source).isNull(), "reply has another shape")
    said = payloads.select(F.col("request_key").alias("query_id"), "source", S.first_line(error).alias("error"), F.coalesce(S.retryable(F.col("status")), F.lit(False)).alias("retryable"))
    return said.filter("error IS NOT NULL")


ENRICH_BUDGET = 12


def enrich(listings: DataFrame, pages: DataFrame, budget: int = ENRICH_BUDGET) -> DataFrame:
    """Fills null ean, sku and brand of each query's first ``budget`` listings without EAN from their product pages; pages with neither ean nor sku are passed over."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id", F.col("ean").isNull()).orderBy("arrival"))
    facts = pages.select("source", F.col("id"), *[F.col(c).alias(f"_{c}") for c in ("ean", "sku", "brand")])
    chosen = listings.withColumn("_due", F.col("ean").isNull() & (rank <= budget) & ~F.coalesce(F.col("source").isin(*WITHOUT_PAGES), F.lit(False)))
    joined = chosen.join(facts, ["source", "id"], "left")
    useful = F.col("_due") & (F.col("_ean").isNotNull() | F.col("_sku").isNotNull())
    filled = {c: F.coalesce(F.col(c), F.when(useful, F.col(f"_{c}"))) for c in ("ean", "sku", "brand")}
    return joined.withColumn("enriched", useful).withColumns(filled).drop("_due", "_ean", "_sku", "_brand")
