"""The engine as named tools of a line-based JSON-RPC client: one line in, at most one line out."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Engine, known_source
from .functions import scalars as S
from .operators import matching as M
from .operators.filters import Filters
from .sources import parsers, registry

# The protocol's version, error codes, and the tools with their arguments.
PROTOCOL = "2024-11-05"
PARSE_ERROR, METHOD_NOT_FOUND = -32700, -32601
FILTERS = {"min_price": "number", "max_price": "number", "in_stock": "boolean", "min_inches": "integer", "max_inches": "integer", "brand": "string", "devices_only": "boolean"}
KEY = {"product_id": "string", "source": "string"}
TOOLS = {
    "search": ("Listings of all retailers, or of one.", {"query": "string", "limit": "integer", "source": "string"} | FILTERS, ["query"]),
    "compare": ("One entry a product, over all retailers.", {"query": "string", "limit": "integer", "threshold": "number", "multi_only": "boolean", "enrich": "boolean"} | FILTERS, ["query"]),
    "set_alert": ("Watch a product until it costs a target price or less; tracks it too.", KEY | {"below": "number"}, ["product_id", "source", "below"]),
    "clear_alert": ("Remove a price alert.", KEY, ["product_id", "source"]),
    "list_alerts": ("Price alerts with current prices, and whether they are reached.", {}, []),
    "get_product": ("One product by id or URL.", {"id": "string", "source": "string"}, ["id", "source"]),
    "track": ("Record a product's price on each refresh.", KEY, ["product_id", "source"]),
    "untrack": ("Stop tracking a product.", KEY, ["product_id", "source"]),
    "list_tracked": ("Tracked products with their last price.", {}, []),
    "price_history": ("A product and its recorded prices, newest first.", KEY | {"limit": "integer"}, ["product_id", "source"]),
    "refresh": ("Record the tracked products' pages.", {}, []),
    "sources": ("The retailers and what each can do.", {}, []),
    "stats": ("Numbers of products, price points and tracked products.", {}, []),
}
#: Rows of one reply at most; what is longer is to be read as a table.
MOST_ROWS = 10_000


def definitions() -> list[dict]:
    schema = lambda properties, needed: {"type": "object", "properties": {k: {"type": t} for k, t in properties.items()}} | ({"required": needed} if needed else {})
    return [{"name": n, "description": d, "inputSchema": schema(p, r)} for n, (d, p, r) in TOOLS.items()]


def rows(df: DataFrame) -> list[dict]:
    """A reply's rows, in the frame's order; a reply of over ``MOST_ROWS`` rows is an error, not a cut one."""
    found = [json.loads(x) for x in df.limit(MOST_ROWS + 1).toJSON().collect()]
    if len(found) > MOST_ROWS:
        raise ValueError(f"the reply has over {MOST_ROWS} rows; read the table")
    return found


def text_of(arguments: dict, name: str) -> str:
    value = arguments.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"missing required argument: {name}")
    return value


def number_of(arguments: dict, name: str, whole: bool = False) -> float | int | None:
    """A number, or None where there is none (of another type, negative where whole numbers are asked for, or not finite)."""
    value = arguments.get(name)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or whole and (not isinstance(value, int) or value < 0):
        return None
    return value


def filters_of(arguments: dict) -> Filters:
    brand = arguments.get("brand")
    return Filters(
        min_price=number_of(arguments, "min_price"), max_price=number_of(arguments, "max_price"), in_stock_only=arguments.get("in_stock") is True, devices_only=arguments.get("devices_only") is True,
        brand=brand if isinstance(brand, str) else None, min_inches=number_of(arguments, "min_inches", True), max_inches=number_of(arguments, "max_inches", True),
    )


def or_else(value: Any, default: Any) -> Any:
    return default if value is None else value


def said(errors: DataFrame) -> list[dict]:
    return rows(errors.select("source", "error").distinct().orderBy("source", "error"))


def call(engine: Engine, name: str, arguments: dict, payloads: DataFrame | None) -> Any:
    if payloads is None:
        payloads = engine.spark.createDataFrame([], "source string, kind string, request_key string, status int, final_url string, headers map<string,string>, body string")
    key = lambda: (text_of(arguments, "product_id"), known_source(text_of(arguments, "source")))
    limit = number_of(arguments, "limit", True)
    if name == "search":
        query, source = text_of(arguments, "query"), arguments.get("source")
        found = engine.search(payloads, or_else(limit, 10), source if isinstance(source, str) else None, filters_of(arguments), query)
        return {"query": query, "results": rows(found.rows.orderBy("arrival").drop("arrival", "query_id")), **found.counts, "errors": said(found.errors)}
    if name == "compare":
        query = text_of(arguments, "query")
        found = engine.compare(payloads, or_else(limit, 10), or_else(number_of(arguments, "threshold"), M.THRESHOLD), arguments.get("multi_only") is True, arguments.get("enrich") is True, filters_of(arguments), query)
        counts = {k: v for k, v in found.counts.items() if k != "total_hits"}
        return {"query": query, "groups": rows(found.rows), **counts, "errors": said(found.errors)}
    if name == "set_alert":
        product, source = key()
        below = number_of(arguments, "below")
        if below is None or below <= 0:
            raise ValueError("below must be a positive price")
        engine.set_alert(product, source, below)
        return {"alert_set": True, "product_id": product, "source": source, "target_price": below}
    if name in ("clear_alert", "untrack"):
        product, source = key()
        done = getattr(engine, name)(product, source)
        return {"alert_cleared" if name == "clear_alert" else "untracked": done, "product_id": product, "source": source}
    if name == "track":
        product, source = key()
        engine.track(product, source)
        return {"tracked": True, "product_id": product, "source": source}
    if name == "list_alerts":
        return rows(engine.alerts())
    if name == "list_tracked":
        return rows(engine.tracked())
    if name == "get_product":
        return get_product(engine, text_of(arguments, "id"), known_source(text_of(arguments, "source")), payloads)
    if name == "price_history":
        product, source = key()
        known = rows(engine.get_product(product, source))
        return {"product": known[0] if known else None, "history": rows(engine.price_history(product, source, or_else(limit, 30)))}
    if name == "refresh":
        done = engine.refresh(payloads)
        return done | {"alerts_triggered": rows(done["alerts_triggered"]), "errors": rows(done["errors"])}
    if name == "sources":
        return rows(registry.sources(engine.spark).orderBy("rank"))
    if name == "stats":
        return engine.stats()
    raise ValueError(f"unknown tool: {name}")


def get_product(engine: Engine, wanted: str, source: str, payloads: DataFrame) -> dict:
    """A product from its captured page (which is recorded), else as it's stored."""
    if wanted.startswith("http"):
        found = engine.spark.range(1).select(S.url_id(F.lit(source), F.lit(wanted)).alias("id")).first().id
        if not found:
            raise ValueError(f"could not read a product id from {wanted}")
        wanted = found
    pages = parsers.product_listings(payloads.filter((F.col("source") == source) & (F.col("request_key") == wanted)))
    page = pages.limit(1).cache()
    try:
        got = rows(page.drop("query_id", "rank"))
        if got:
            engine.record(page)
            return got[0]
    finally:
        page.unpersist()
    known = rows(engine.get_product(wanted, source))
    if not known:
        raise ValueError(f"{wanted} not found on {source}")
    return known[0]


def handle(engine: Engine, line: str, payloads: DataFrame | None = None) -> str | None:
    """The reply to a line; none to a notification (no id, or a null one). A tool that fails says so in its result, whatever the failure."""
    try:
        request = json.loads(line)
        if not isinstance(request, dict) or not isinstance(request.get("method", ""), (str, type(None))):
            raise ValueError("no request")
        params = or_else(request.get("params"), {})
        if not isinstance(params, dict) or not isinstance(params.get("name", ""), (str, type(None))):
            raise ValueError("params are no object with a name")
    except (ValueError, RecursionError) as e:
        return json.dumps({"jsonrpc": "2.0", "error": {"code": PARSE_ERROR, "message": f"parse error: {e}"}})
    number, method = request.get("id"), request.get("method") or ""
    reply: dict = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        reply["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "offerlens", "version": "0.3.0"}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": definitions()}
    elif method == "tools/call":
        try:
            arguments = params.get("arguments")
            text, failed = json.dumps(call(engine, params.get("name") or "", arguments if isinstance(arguments, dict) else {}, payloads), default=str, ensure_ascii=False), False
        except Exception as e:  # the client tells a broken tool from an empty result by isError
            text, failed = (str(e).splitlines() or [type(e).__name__])[0], True
        reply["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        reply["error"] = {"code": METHOD_NOT_FOUND, "message": f"unknown method: {method}"}
    return None if number is None else json.dumps(reply, ensure_ascii=False)
