"""The engine's functions for SQL: ``register(spark)`` puts them in the session's catalogue.

``offer_fold``, ``offer_tokens``, ``offer_price``, ``offer_stock`` are SQL functions (they become native expressions of the plan);
``page_cards(source, body)`` and ``page_product(source, body)`` are table functions for ``LATERAL``: a page in, its cards' or product's raw fields out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.markup import parse
from ..sources.parsers import CARDS, RAW, product_page
from .scalars import IN_STOCK, OUT_OF_STOCK
from .text import FOLD_FROM, FOLD_TO, UNITS

FIELDS = "rank int, " + ", ".join(f"{c} string" for c in RAW)
_FRACTION = "regexp_extract(kept, '[.,]([0-9]*)$', 1)"
FUNCTIONS = {
    "offer_fold(text STRING) RETURNS STRING": f"replace(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), 'ß', 'ss')",
    "offer_tokens(text STRING) RETURNS ARRAY<STRING>": (
        "filter(split(regexp_replace(trim(regexp_replace(regexp_replace(offer_fold(text), '(?<=[0-9][\"”″]{0,8})[\"”″]', 'inch'), '[^0-9a-z]+', ' ')), "
        f"'\\\\b([0-9]+) ({UNITS})\\\\b', '$1$2'), ' '), t -> t != '')"
    ),
    "offer_number(kept STRING) RETURNS DOUBLE": (
        "CASE WHEN kept RLIKE '[0-9]' THEN try_cast(CASE WHEN regexp_extract(kept, '([.,])[0-9]*$', 1) != '' "
        f"AND (contains(kept, '.') AND contains(kept, ',') OR length({_FRACTION}) != 3) THEN concat(regexp_replace(regexp_replace(kept, '[.,][0-9]*$', ''), '[.,]', ''), "
        f"CASE WHEN {_FRACTION} != '' THEN concat('.', {_FRACTION}) ELSE '' END) ELSE regexp_replace(kept, '[.,]', '') END AS DOUBLE) END"
    ),
    "offer_price(text STRING) RETURNS DOUBLE": "offer_number(regexp_replace(text, '[^0-9.,]', ''))",
    "offer_stock(text STRING) RETURNS BOOLEAN": f"CASE WHEN trim(lower(text)) = '' THEN NULL WHEN lower(text) RLIKE '{'|'.join(OUT_OF_STOCK)}' THEN false WHEN lower(text) RLIKE '{'|'.join(IN_STOCK)}' THEN true END",
}


@udtf(returnType=FIELDS)
class PageCards:
    """The cards of a page of listings, in order; none for a source without such pages."""

    def eval(self, source: str, body: str) -> Iterator[tuple]:
        if source in CARDS:
            for rank, card in enumerate(CARDS[source](parse(body or ""))):
                yield (rank, *(card.get(c) for c in RAW))


@udtf(returnType=FIELDS)
class PageProduct:
    """The product of a page, if it has one."""

    def eval(self, source: str, body: str) -> Iterator[tuple]:
        found = product_page(source, parse(body or "")) if source else None
        if found is not None:
            yield (0, *(found.get(c) for c in RAW))


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("page_cards", PageCards)
    spark.udtf.register("page_product", PageProduct)
