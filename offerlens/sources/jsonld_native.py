"""The schema.org product of a page's JSON-LD by VARIANT: no Python row on the executors.

Scripts are taken by a pattern, parsed by ``try_parse_json`` and walked level by level, each written as it is found so that none is read twice: arrays and the ``@graph`` of objects that are no product are exploded,
until none is left; the first product in the order of the page wins. Fields and offers are then read by native expressions. It gives
what ``jsonld.find`` gives, but for offers that lie deeper than ``OFFER_DEPTH`` below one another, and lists within lists of brands, images or offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import written
from .jsonld import FIELDS, GTIN_KEYS

SCRIPT = r"""(?is)<script\b(?=[^>]*\btype\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json[\s>]))[^>]*>(.*?)(?:</script\b[^>]*>|\z)"""
OFFER_DEPTH = 4


def _kind(v: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BOOLEAN`` or a number's type; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column) -> Column:
    """A string (trimmed, not empty) or number as text."""
    return F.when(_kind(v) == "STRING", F.nullif(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", ""), F.lit(""))).when(~_kind(v).isin("OBJECT", "ARRAY", "BOOLEAN", "VOID"), F.to_json(v))


def _items(v: Column) -> Column:
    """The elements of an array, or the value itself as the only one."""
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _first(texts: Column) -> Column:
    return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))


def _named(v: Column) -> Column:
    one = lambda x: F.when(_kind(x) == "OBJECT", _text(_at(x, "$.name"))).when(_kind(x) == "STRING", _text(x))
    return _first(F.transform(_items(v), one))


def _image(v: Column) -> Column:
    one = lambda x: F.when(_kind(x) == "OBJECT", F.coalesce(_text(_at(x, "$.url")), _text(_at(x, "$.contentUrl")))).when(_kind(x) == "STRING", _text(x))
    return _first(F.transform(_items(v), one))


def _is_product(v: Column) -> Column:
    kinds = F.transform(_items(_at(v, '$["@type"]')), lambda k: F.when(_kind(k) == "STRING", F.lower(F.try_variant_get(k, "$", "string"))))
    return F.coalesce((_kind(v) == "OBJECT") & F.array_contains(F.filter(kinds, lambda k: k.isNotNull()), "product"), F.lit(False))


def _for_consumers(offer: Column) -> Column:
    customer = _at(offer, "$.eligibleCustomerType")
    name = F.when(_kind(customer) == "OBJECT", _text(_at(customer, '$["@id"]'))).otherwise(_text(customer))
    spec = F.get(_items(_at(offer, "$.priceSpecification")), F.lit(0))
    taxed = _at(spec, "$.valueAddedTaxIncluded")
    return F.coalesce(F.contains(F.lower(name), F.lit("public")), F.lit(False)) | F.coalesce((_kind(taxed) == "BOOLEAN") & F.try_variant_get(taxed, "$", "boolean"), F.lit(False))


def _chosen(v: Column) -> Column:
    """Of offers the first for consumers, else the first object; its own place among them stays."""
    objects = F.filter(_items(v), lambda o: F.coalesce(_kind(o) == "OBJECT", F.lit(False)))
    return F.coalesce(F.get(F.filter(objects, _for_consumers), F.lit(0)), F.get(objects, F.lit(0)))


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, node): every product node of every page, with its place."""
    scripts = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(SCRIPT), 1)).alias("n", "script"))
    level = scripts.select(key, F.array("n").alias("place"), F.try_parse_json("script").alias("v"))
    found = None
    while True:
        level = level.withColumn("kind", _kind(F.col("v"))).filter("kind IN ('ARRAY', 'OBJECT')")
        level = written(level.withColumn("product", (F.col("kind") == "OBJECT") & _is_product(F.col("v"))), "nodes")
        done = level.filter("product").select(key, "place", F.col("v").alias("node"))
        found = done if found is None else found.unionByName(done)
        inner = F.when(F.col("kind") == "ARRAY", F.col("v")).otherwise(_at(F.col("v"), '$["@graph"]'))
        deeper = level.filter("NOT product").select(key, "place", inner.alias("v")).filter("v IS NOT NULL")
        if deeper.isEmpty():
            return found
        level = deeper.select(key, "place", F.posexplode(_items(F.col("v"))).alias("n", "v")).select(key, F.concat("place", F.array("n")).alias("place"), "v")


def products(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key`` and the fields of the first product node of each page that has one; price and availability as text."""
    found = nodes(pages, key, html).groupBy(key).agg(F.min_by("node", "place").alias("node"))
    v = F.col("node")
    rows = found.select(key, v, _chosen(_at(v, "$.offers")).alias("offer"))
    for _ in range(OFFER_DEPTH - 1):  # an aggregate's own offers
        below = _chosen(_at(F.col("offer"), "$.offers"))
        rows = rows.withColumn("offer", F.coalesce(F.when(F.to_json(below) != "{}", below), F.col("offer")))
    offer = F.col("offer")
    values = {c: _text(_at(v, f"$.{c}")) for c in ("name", "sku", "mpn")} | {
        "gtin": F.coalesce(*(_text(_at(v, f"$.{c}")) for c in GTIN_KEYS)), "brand": _named(_at(v, "$.brand")), "image": _image(_at(v, "$.image")),
        "url": F.coalesce(_text(_at(offer, "$.url")), _text(_at(v, "$.url"))), "price": _text(_at(offer, "$.price")), "availability": _text(_at(offer, "$.availability")),
    }
    return rows.select(key, *(values[c].alias(c) for c in FIELDS))
