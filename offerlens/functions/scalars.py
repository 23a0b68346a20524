"""Scalar helpers of listings, as native column expressions; a few small Python ones for the driver."""

from __future__ import annotations

import math
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that say a product is not, or is, in stock (the first list counts first).
OUT_OF_STOCK = (
    "saatavilla toimittajalta", "tilattavissa toimittajalta", "loppuunmyyty", "loppu varastosta", "ei varastossa",
    "tilapäisesti loppu", "tilapaisesti loppu", "ei saatavilla", "out of stock", "sold out", "not available",
    "ej i lager", "saapuu", "ennakkotilaus",
)
IN_STOCK = ("varastossa", "heti", "saatavilla", "toimitusaika", "in stock", "available", "i lager", "noudettavissa", "myymälässä", "myymalassa")
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
MOST_DELAY = 3600.0


def price(raw: Column) -> Column:
    """A price in any of the usual notations as double, null if there is none.

    The last of two kinds of separators is the decimal one; a single kind is, unless exactly three digits follow it.
    """
    kept = F.regexp_replace(raw, "[^0-9.,]", "")
    last = F.regexp_extract(kept, r"([.,])[0-9]*$", 1)
    after = F.length(F.regexp_extract(kept, r"[.,]([0-9]*)$", 1))
    both = kept.contains(".") & kept.contains(",")
    decimal = (last != "") & (both | (after != 3))
    whole = F.regexp_replace(F.regexp_replace(kept, r"[.,][0-9]*$", ""), "[.,]", "")
    fraction = F.regexp_extract(kept, r"[.,]([0-9]*)$", 1)
    number = F.when(decimal, F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))).otherwise(F.regexp_replace(kept, "[.,]", ""))
    return F.when(kept.rlike("[0-9]"), number.try_cast("double"))


def stock(raw: Column) -> Column:
    """true or false by the phrase, null if it says neither."""
    low = F.lower(raw)
    any_of = lambda words: low.rlike("|".join(words))
    return F.when(F.trim(low) == "", None).when(any_of(OUT_OF_STOCK), False).when(any_of(IN_STOCK), True)


def absolute_url(origin: Column, href: Column) -> Column:
    href = F.trim(href)
    return (
        F.when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.rtrim(origin, F.lit("/")), href))
        .otherwise(F.concat(F.rtrim(origin, F.lit("/")), F.lit("/"), href))
    )


def squeeze(text: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def url_encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def delay_seconds(seconds: Column) -> Column:
    """Seconds between 0 and an hour; null for what is no finite number."""
    finite = ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    return F.when(finite, F.least(F.greatest(seconds, F.lit(0.0)), F.lit(MOST_DELAY)))


def source_key(text: Column) -> Column:
    """What a source's name, id or domain boils down to; to be looked up in the table of sources."""
    return F.split_part(F.regexp_replace(F.lower(F.trim(text)), r"^www\.", ""), F.lit("."), F.lit(1))


def timestamp(text: Column) -> Column:
    return F.coalesce(text.try_cast("timestamp"), F.lit("1970-01-01 00:00:00").cast("timestamp"))


#: Patterns of the id in a product URL, by source.
URL_IDS = {
    "datatronic": (r"id_product=([0-9]+)", r"^(?:[^?#]*/)?([0-9]+)[^/?#]*(?:[?#].*)?$"),
    "verkkokauppa": (r"/product/([0-9]+)",),
    "power": (r"^.*/p-([0-9]*)",),
    "jimms": (r"(?i)/product/show/([0-9]+)",),
    "multitronic": (r"/products/([0-9]+)",),
    "proshop": (r"^[^?#]*?([^/?#]*[0-9A-Za-z][^/?#]*)/*(?:[?#].*)?$",),
    "gigantti": (r"^[^?#]*?([^/?#]*[0-9A-Za-z][^/?#]*)/*(?:[?#].*)?$",),
}


def url_id(source: Column, url: Column) -> Column:
    found = None
    for name, patterns in URL_IDS.items():
        value = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])
        found = F.when(source == name, value) if found is None else found.when(source == name, value)
    return found


def availability_code(code: Column) -> Column:
    return F.when(code == 1, True).when(code.isin(0, 2, 4), False)


def schema_availability(text: Column) -> Column:
    return F.lower(text).rlike("instock|limitedavailability")


def price_label(value: Column) -> Column:
    return F.format_string("%.2f EUR", value)


def stock_label(value: Column) -> Column:
    return F.when(value.isNull(), "stock unknown").when(value, "in stock").otherwise("out of stock")


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def basis_label(basis: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("ean", "sku", "model", "name"))), basis + 1)


def described(inches: Column, capacity: Column, qualifiers: Column, kind: Column) -> Column:
    """Attributes in words: 65", 2 TB, qualifiers, kind if it is no device."""
    size = F.when(inches.isNotNull(), F.concat(inches.cast("string"), F.lit('"')))
    room = F.when((capacity >= 1000) & (capacity % 1000 == 0), F.concat((capacity / 1000).cast("bigint").cast("string"), F.lit(" TB"))).when(capacity.isNotNull(), F.concat(capacity.cast("string"), F.lit(" GB")))
    words = F.concat_ws(", ", size, room, F.nullif(F.array_join(qualifiers, ", "), F.lit("")), F.when(kind != "device", kind))
    return F.when(words == "", "").otherwise(F.concat(F.lit("  ["), words, F.lit("]")))


def with_vendor(vendor: Column, name: Column) -> Column:
    """A name with its vendor before it, unless it begins with it."""
    return F.when(vendor.isNull() | (F.trim(vendor) == "") | F.startswith(F.lower(name), F.lower(vendor)), name).otherwise(F.concat_ws(" ", vendor, name))


def backoff(attempt: Column, retry_after: Column, jitter: Column, base: float = 0.8, most: float = 30.0) -> Column:
    """Seconds to wait before the next attempt; a server's own wish wins, within ``most``."""
    grown = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(16))), F.lit(most))
    share = F.lit(0.5) + F.lit(0.5) * F.least(F.greatest(jitter, F.lit(0.0)), F.lit(1.0))
    return F.when(retry_after.isNotNull(), F.least(retry_after.cast("double"), F.lit(most))).otherwise(grown * share)


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def bot_challenge(status: Column, headers: Column) -> Column:
    """Whether a reply is a bot challenge, by its status and headers."""
    value = lambda name: F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"]
    return F.coalesce(F.lower(value("x-vercel-mitigated")) == "challenge", F.lit(False)) | F.coalesce((status == 429) & value("x-vercel-challenge-token").isNotNull(), F.lit(False))


def retry_after_seconds(header: str, now: float) -> float | None:
    """Seconds, or a date, of a Retry-After header."""
    text = header.strip()
    if text.isdigit():
        return float(text)
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - now)
    except (TypeError, ValueError):
        return None


def pacing(seconds: float) -> float | None:
    return min(max(seconds, 0.0), MOST_DELAY) if math.isfinite(seconds) else None
