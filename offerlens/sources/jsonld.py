"""The schema.org product of a page's JSON-LD."""

from __future__ import annotations

import json
from collections.abc import Iterator

from .markup import Node, parse

GTIN_KEYS = ("gtin13", "gtin", "gtin12", "gtin14", "gtin8")
FIELDS = ("name", "sku", "mpn", "gtin", "brand", "image", "url", "price", "availability")


def _text(value) -> str | None:
    """A string (trimmed) or number as text."""
    if isinstance(value, str):
        return value.strip() or None
    return json.dumps(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _named(value) -> str | None:
    if isinstance(value, list):
        return next((x for x in map(_named, value) if x), None)
    return _text(value.get("name")) if isinstance(value, dict) else _text(value) if isinstance(value, str) else None


def _image(value) -> str | None:
    if isinstance(value, list):
        return next((x for x in map(_image, value) if x), None)
    if isinstance(value, dict):
        return _text(value.get("url")) or _text(value.get("contentUrl"))
    return _text(value) if isinstance(value, str) else None


def _is_product(value: dict) -> bool:
    kinds = value.get("@type")
    return any(isinstance(k, str) and k.lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds]))


def _products(value) -> Iterator[dict]:
    if isinstance(value, list):
        for item in value:
            yield from _products(item)
    elif isinstance(value, dict):
        if _is_product(value):
            yield value
        elif "@graph" in value:
            yield from _products(value["@graph"])


def _for_consumers(offer) -> bool:
    """Whether an offer names the public as its customer, or states its first price with VAT."""
    if not isinstance(offer, dict):
        return False
    customer = offer.get("eligibleCustomerType")
    name = _text(customer.get("@id") if isinstance(customer, dict) else customer)
    spec = offer.get("priceSpecification")
    spec = (spec[:1] or [None])[0] if isinstance(spec, list) else spec
    return "public" in (name or "").lower() or isinstance(spec, dict) and spec.get("valueAddedTaxIncluded") is True


def _offer(value) -> dict | None:
    if isinstance(value, dict):
        return _offer(value.get("offers")) or value
    if isinstance(value, list):
        ordered = [x for x in value if _for_consumers(x)][:1] + value
        return next((o for o in map(_offer, ordered) if o is not None), None)
    return None


def find(page: str | Node) -> dict | None:
    """The first product node over all JSON-LD scripts (those that are no JSON are skipped); price and availability as text."""
    top = parse(page) if isinstance(page, str) else page
    for script in top.all('script[type="application/ld+json"]'):
        try:
            product = next(_products(json.loads(script.text())), None)
        except (ValueError, RecursionError):
            continue
        if product is not None:
            offer = _offer(product.get("offers")) or {}
            return {
                "name": _text(product.get("name")), "sku": _text(product.get("sku")), "mpn": _text(product.get("mpn")),
                "gtin": next((t for t in (_text(product.get(k)) for k in GTIN_KEYS) if t), None),
                "brand": _named(product.get("brand")), "image": _image(product.get("image")),
                "url": _text(offer.get("url")) or _text(product.get("url")), "price": _text(offer.get("price")), "availability": _text(offer.get("availability")),
            }
    return None
