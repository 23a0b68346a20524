"""The retailers: what each can do, and how its replies are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SOURCES

# Rank, id, name, domain, origin, search, product_lookup, ean_in_search, page_cap, transport, disallowed, notes.
ROWS = [
    (0, "datatronic", "datatronic.fi", "www.datatronic.fi", "https://www.datatronic.fi", True, True, False, 100, "html", False, "EAN and brand are on product pages only"),
    (1, "verkkokauppa", "verkkokauppa.com", "www.verkkokauppa.com", "https://www.verkkokauppa.com", True, True, True, 100, "json", False, "stock comes with a second reply"),
    (2, "power", "power.fi", "www.power.fi", "https://www.power.fi", True, True, True, 100, "json", False, ""),
    (3, "jimms", "jimms.fi", "www.jimms.fi", "https://www.jimms.fi", True, True, False, 100, "json", True, "EAN is on product pages only"),
    (4, "multitronic", "multitronic.fi", "www.multitronic.fi", "https://www.multitronic.fi", True, True, False, 24, "html", True, "product pages have JSON-LD"),
    (5, "proshop", "proshop.fi", "www.proshop.fi", "https://www.proshop.fi", True, True, False, 100, "html", False, ""),
    (6, "gigantti", "gigantti.fi", "www.gigantti.fi", "https://www.gigantti.fi", False, True, False, 0, "html", True, "product pages only"),
]
ORIGIN = {r[1]: r[4] for r in ROWS}
#: Listings on a page of search results; sources whose product pages can't be looked up.
PAGE_CAP = {r[1]: r[8] for r in ROWS if r[8] != 100 and r[5]}
WITHOUT_PAGES = [r[1] for r in ROWS if not r[6]]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SOURCES)


def searchable(spark: SparkSession) -> DataFrame:
    return sources(spark).filter("search").orderBy("rank")


def resolve(text: str) -> str | None:
    """The id that a source's id, name or domain stands for; null for any other text."""
    key = text.strip().lower().removeprefix("www.").split(".")[0]
    return key if key in ORIGIN else None
