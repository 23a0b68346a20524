"""Identity evidence in product names, as native column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to ASCII, and what they fold to.
FOLD_FROM, FOLD_TO = "äåáàâöøóòôüúùéèêíì", "aaaaaooooouuueeeii"
# Storage units in gigabytes, and spellings of measures.
STORAGE = {"kb": "1e-6D", "kt": "1e-6D", "mb": "1e-3D", "mt": "1e-3D", "gb": "1.0D", "gt": "1.0D", "tb": "1000.0D", "tt": "1000.0D"}
MEASURES = {"hz": "hz", "khz": "khz", "mhz": "mhz", "ghz": "ghz", "w": "w", "wh": "wh", "mm": "mm", "cm": "cm", "inch": "inch", "in": "inch", "tuuma": "inch", "tuuman": "inch", "tuumaa": "inch"}
# Closed lists of words.
LINE_QUALIFIERS = "ti super xt xtx pro evo plus max ultra lite mini nano se".split()
HEATSINK = "heatsink|jaahdyty|cooler"
BUS_OR_FORM = "x1 x2 x4 x8 x16 x32 2230 2242 2260 2280 22110".split()
STOP_WORDS = "the and for with new ja tai musta valkoinen black white tuote product kpl pcs gaming pc tietokone computer oem box retail bulk v2 gen".split()
ACCESSORY_STEMS, ACCESSORY_WORDS = "teline jalusta kiinnike kaapeli johto adapteri kaukosaadin suojakalvo".split(), "mount bracket stand cable adapter remote cord".split()
SERVICE_STEMS, SERVICE_WORDS = "palvelu asennus huolto takuu vakuutus".split(), "service installation warranty insurance".split()

UNITS = "|".join(sorted([*STORAGE, *MEASURES], key=len, reverse=True))


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def fold(text: Column) -> Column:
    """Lower case with Nordic and accented vowels as ASCII."""
    return F.replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))


def expand_inch_marks(folded: Column) -> Column:
    """Inch marks after a digit (or after such a mark) as the word inch."""
    return F.regexp_replace(folded, r'(?<=[0-9]["”″]{0,8})["”″]', "inch")


def tokens(expanded: Column) -> Column:
    """ASCII alphanumeric tokens; a number and the unit word after it are one."""
    spaced = F.trim(F.regexp_replace(expanded, "[^0-9a-z]+", " "))
    joined = F.regexp_replace(spaced, rf"\b([0-9]+) ({UNITS})\b", "$1$2")
    return F.filter(F.split(joined, " "), lambda t: t != "")


def canonical_sql(token: str) -> str:
    """SQL for a measurement in its canonical form, null for any other token."""
    number = f"cast(regexp_extract({token}, '^([0-9]+)', 1) AS double)"
    unit = f"regexp_extract({token}, '^[0-9]+([a-z][0-9a-z]*)$', 1)"
    cases = " ".join(f"WHEN '{u}' THEN concat('cap:', cast(round({number} * {f}) AS bigint), 'gb')" for u, f in STORAGE.items())
    cases += " " + " ".join(f"WHEN '{u}' THEN concat(cast(round({number}) AS bigint), '{c}')" for u, c in MEASURES.items())
    return f"CASE {unit} {cases} END"


def spec_tokens(toks: str) -> Column:
    return F.expr(f"array_sort(array_distinct(filter(transform({toks}, t -> {canonical_sql('t')}), s -> s IS NOT NULL)))")


def model_tokens(toks: str) -> Column:
    """Tokens that name a model: letters and digits, or three digits and more; no measures, lane widths or form factors."""
    return F.expr(
        f"array_sort(array_distinct(filter({toks}, t -> t RLIKE '[0-9]' AND (t RLIKE '[a-z]' OR length(t) >= 3) "
        f"AND t NOT IN ({_in(BUS_OR_FORM)}) AND NOT coalesce(t RLIKE '^[0-9]+({UNITS})$', false))))"
    )


def name_tokens(toks: str) -> Column:
    return F.expr(f"array_sort(array_distinct(transform(filter({toks}, t -> length(t) > 1 AND t NOT IN ({_in(STOP_WORDS)})), t -> coalesce({canonical_sql('t')}, t))))")


def qualifiers(expanded: str, toks: str) -> Column:
    cooled = f"{expanded} RLIKE '{HEATSINK}' AND NOT ({expanded} RLIKE 'ilman |without ')"
    return F.expr(f"array_sort(array_distinct(concat(filter({toks}, t -> t IN ({_in(LINE_QUALIFIERS)})), CASE WHEN {cooled} THEN array('heatsink') ELSE array() END)))")


def kind(expanded: str, toks: str, specs: str) -> Column:
    """service, accessory or device."""

    def says(stems: list[str], words: list[str]) -> str:
        return f"exists({toks}, t -> t IN ({_in(words)}) OR t RLIKE '{'|'.join(stems)}')"

    sizes = f"(size(filter({specs}, s -> s LIKE '%inch')) >= 2 OR {expanded} RLIKE '[0-9]-[0-9]+inch')"
    return F.expr(f"CASE WHEN {says(SERVICE_STEMS, SERVICE_WORDS)} THEN 'service' WHEN {says(ACCESSORY_STEMS, ACCESSORY_WORDS)} OR {sizes} THEN 'accessory' ELSE 'device' END")


def largest(specs: str, prefix: str, suffix: str, kind_: str) -> Column:
    """The largest number among measurements ``prefix<number>suffix``."""
    return F.expr(f"array_max(transform(filter({specs}, s -> s RLIKE '^{prefix}[0-9]+{suffix}$'), s -> try_cast(regexp_extract(s, '([0-9]+){suffix}$', 1) AS {kind_})))")


def gtin(raw: str) -> Column:
    """A GTIN of 8 or 13 digits with a right check digit that is no placeholder, else null."""
    digits = f"regexp_replace({raw}, '[^0-9]', '')"
    body = f"CASE length({digits}) WHEN 8 THEN {digits} WHEN 12 THEN concat('0', {digits}) WHEN 13 THEN {digits} WHEN 14 THEN substr({digits}, 2) END"
    odd = "(length(b) - 1 - i) % 2 = 1"
    total = f"aggregate(transform(sequence(1, length(b) - 1), i -> cast(substr(b, i, 1) AS int) * CASE WHEN {odd.replace('length(b) - 1 - i', 'length(b) - i')} THEN 3 ELSE 1 END), 0, (a, x) -> a + x)"
    valid = f"(10 - {total} % 10) % 10 = cast(right(b, 1) AS int)"
    cycle = "exists(array(1, 2, 3), k -> left(repeat(left(left(b, length(b) - 1), k), 13), length(b) - 1) = left(b, length(b) - 1))"
    return F.expr(f"element_at(transform(array({body}), b -> CASE WHEN b IS NOT NULL AND {valid} AND NOT {cycle} THEN b END), 1)")


def sku(raw: Column) -> Column:
    plain = F.regexp_replace(fold(raw), "[^a-z0-9]", "")
    return F.when(F.length(plain) >= 4, plain)


def brand(raw: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(fold(raw), "[^a-z0-9 ]", "")), F.lit(""))
