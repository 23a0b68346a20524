"""Entity resolution: which listings of different retailers are one product.

Pairs are scored only where they can pass. Above 0.40 a pair needs an equal EAN or SKU, or a shared model token; for thresholds of 0.10 to 0.40 name tokens are
keys too, by a prefix filter: the smaller set offers only as many of its rarest tokens as the threshold can't do without. What forbids a pair is part of
its key: qualifiers must be equal, and where both state an EAN, a capacity or a size these too. A pair is kept at its first key only, so
nothing is made distinct; keys that many listings share are dealt out by salt. So much for large queries: the listings of a query of up to ``AT_ONCE``
are shuffled once, not once for each key, and held against one another under the same conditions.

Grouping follows the order of arrival. A listing is assigned by its links to earlier ones (a cluster is open to it if it has as many links into it as the
cluster has members), in one walk over sorted links that holds a few numbers a listing; queries of many links are walked component by component. The rule
then merges clusters all of whose listings are linked. No such two can be left, so nothing is done for it: the first member of the later one found, when
it came, a member of the earlier one that it has no link to (or it would have joined a cluster), and members stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import written as _written
from ..functions.scalars import basis_label
from .identity import SIGNATURE

THRESHOLD = 0.55
EAN, SKU, MODEL, NAME = range(4)


def _overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / smaller.cast("double"))


def _conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def verdict(a: str = "a", b: str = "b") -> Column:
    """(score, basis) of two signed listings in struct columns, null if they can't be one product."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    pair = lambda score, basis: F.struct(F.lit(score).cast("double").alias("score"), F.lit(basis).alias("basis"))
    apart = lambda n: (F.size(x(n)) > 0) & (F.size(y(n)) > 0) & ~F.arrays_overlap(x(n), y(n))
    shared = F.array_intersect(x("model_tokens"), y("model_tokens"))
    longest = F.coalesce(F.array_max(F.transform(shared, F.length)), F.lit(0))
    model = _overlap(x("model_tokens"), y("model_tokens")) * F.least(longest.cast("double") / F.lit(6.0), F.lit(1.0))
    brand = F.when(x("brand_key").isNull() | y("brand_key").isNull(), 0.5).when(x("brand_key") == y("brand_key"), 1.0).otherwise(0.0)
    score = F.lit(0.60) * model + F.lit(0.30) * _overlap(x("name_tokens"), y("name_tokens")) + F.lit(0.10) * brand
    scored = F.struct(score.alias("score"), F.when(model > 0, F.lit(MODEL)).otherwise(F.lit(NAME)).alias("basis"))
    return (
        F.when(x("ean_key") == y("ean_key"), pair(1.0, EAN))
        .when(x("ean_key") != y("ean_key"), None)
        .when(x("sku_key") == y("sku_key"), pair(0.97, SKU))
        .when(x("qualifiers") != y("qualifiers"), None)
        .when(_conflict(x("capacity_gb"), y("capacity_gb")) | _conflict(x("screen_inches"), y("screen_inches")), None)
        .when(apart("spec_tokens"), None)
        .when(apart("model_tokens"), None)
        .otherwise(scored)
    )


#: A key of more listings than this is dealt out in parts.
HOT = 2048
SEP = "\u0001"


def _slots(value: Column, left: bool) -> Column:
    """Names of which two sides share exactly one if a value is equal or unknown on either side, and none if both state another."""
    text = value.cast("string")
    return F.when(value.isNotNull(), F.array(F.concat(F.lit("v"), text), F.lit("x" if left else "n"))).otherwise(F.array(F.lit("n")) if left else F.array(F.lit("x"), F.lit("n")))


def _apart_slots(stated: Column, left: bool) -> Column:
    """The same, where two sides that both state a value never meet."""
    return F.when(stated, F.array(F.lit("x" if left else "n"))).otherwise(F.array(F.lit("n")) if left else F.array(F.lit("x"), F.lit("n")))


def _crossed(*parts: Column) -> Column:
    """All choices of one text of each array, joined."""
    return reduce(lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(SEP), y)))), parts)


def block_keys(threshold: float, left: bool, small: bool | None = None) -> Column:
    """Keys of one side. ``small`` sides of name keys offer their prefix, others all tokens; None: keys without names."""
    no_ean = _apart_slots(F.col("ean_key").isNotNull(), left)
    sound = [F.array(F.array_join("qualifiers", ",")), no_ean, _slots(F.col("capacity_gb"), left), _slots(F.col("screen_inches"), left)]
    if small is not None:
        tokens = F.transform("prefix" if small else "name_tokens", lambda t: F.concat(F.lit("n"), t))
        return _crossed(tokens, *sound, _apart_slots(F.size("model_tokens") > 0, left))
    none = F.array().cast("array<string>")
    exact = F.when(F.col("ean_key").isNotNull(), F.array(F.concat(F.lit("e"), "ean_key"))).otherwise(none)
    skus = F.when(F.col("sku_key").isNotNull(), _crossed(F.array(F.concat(F.lit("s"), "sku_key")), no_ean)).otherwise(none)
    models = _crossed(F.array(F.lit("q")) if threshold <= 0.10 else F.transform("model_tokens", lambda t: F.concat(F.lit("m"), t)), *sound)
    return F.concat(exact, skus, models)


def _needed(threshold: float, smaller: Column) -> Column:
    """Shared name tokens that a pair needs to reach the threshold by its name, of the size of the smaller set."""
    return F.greatest(F.ceil(F.lit((threshold - 0.10) / 0.30 - 1e-9) * smaller), F.lit(1))


def _with_prefix(signed: DataFrame, threshold: float) -> DataFrame:
    """Adds ``prefix``: the rarest name tokens, as many as the smaller set of a pair that reaches the threshold by its name can't all lack."""
    need = _needed(threshold, F.size("name_tokens"))
    tokens = signed.select("query_id", "arrival", F.explode("name_tokens").alias("t"), (F.size("name_tokens") - need + 1).cast("int").alias("n"))
    counts = tokens.groupBy("query_id", "t").agg(F.count("*").alias("f"))
    ranked = tokens.join(counts, ["query_id", "t"]).groupBy("query_id", "arrival").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "t"))).alias("r"))
    prefix = ranked.select("query_id", "arrival", F.slice("r.t", F.lit(1), F.col("n")).alias("prefix"))
    return signed.join(prefix, ["query_id", "arrival"], "left").withColumn("prefix", F.coalesce("prefix", F.array().cast("array<string>")))


def _met(left: DataFrame, right: DataFrame, hot: int) -> DataFrame:
    """Rows (query_id, key, x: listing) of both sides, joined; the listings of a key with over ``hot`` rows meet in parts."""
    counts = left.groupBy("query_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("query_id", "key", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    parted = lambda side: side.join(counts, ["query_id", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = parted(left).withColumn("part", F.pmod(F.xxhash64("x.arrival"), F.col("parts")).cast("int")).select("query_id", "key", "part", F.col("x").alias("sa"))
    b = parted(right).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query_id", "key", "part", F.col("x").alias("sb"))
    return a.join(b, ["query_id", "key", "part"])


#: Listings of a query of at most so many are held against one another where the query lies; those of larger ones meet by keys.
AT_ONCE = 256


def _by_size(signed: DataFrame, at_once: int) -> tuple[DataFrame, DataFrame | None]:
    """Listings of queries of at most ``at_once``, and those of the others (None: there are none)."""
    large = _written(signed.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") > at_once).select("query_id"), "wide")
    if large.isEmpty():
        return signed, None
    return signed.join(large, "query_id", "left_anti"), signed.join(large, "query_id", "left_semi")


def _side_by_side(signed: DataFrame, meets: Column) -> DataFrame:
    """(query_id, sa, sb): pairs of a query's listings, in order of arrival, that meet the condition on ``sa`` and ``sb``. A listing is shuffled once."""
    side = lambda name: signed.select("query_id", F.struct("arrival", *SIGNATURE).alias(name))
    return side("sa").join(side("sb"), "query_id").filter((F.col("sa.arrival") < F.col("sb.arrival")) & meets)


def _same(name: str) -> Column:
    return F.coalesce(F.col(f"sa.{name}") == F.col(f"sb.{name}"), F.lit(False))


def _may_reach(threshold: float) -> Column:
    """What the keys say, of two listings: an equal EAN comes first, two EANs next, then an equal SKU, then conflicts, then what is shared."""
    x, y = (lambda n: F.col(f"sa.{n}")), (lambda n: F.col(f"sb.{n}"))
    shared = F.lit(True) if threshold <= 0.10 else F.arrays_overlap(x("model_tokens"), y("model_tokens"))
    if 0.10 < threshold <= 0.40:
        smaller = F.least(F.size(x("name_tokens")), F.size(y("name_tokens")))
        one_lacks_models = (F.size(x("model_tokens")) == 0) | (F.size(y("model_tokens")) == 0)
        shared |= one_lacks_models & (F.size(F.array_intersect(x("name_tokens"), y("name_tokens"))) >= _needed(threshold, smaller))
    sound = _same("qualifiers") & ~_conflict(x("capacity_gb"), y("capacity_gb")) & ~_conflict(x("screen_inches"), y("screen_inches"))
    return F.when(x("ean_key") == y("ean_key"), True).when(x("ean_key") != y("ean_key"), False).when(x("sku_key") == y("sku_key"), True).otherwise(sound & shared)


def _kind_and_token() -> tuple[Column, Column]:
    return F.substring("key", 1, 1), F.substring_index(F.substring("key", 2, 1 << 30), SEP, 1)


def _keyed(signed: DataFrame, keys: Column, *columns: str) -> DataFrame:
    """(query_id, key, x) with those columns only that tell a pair's first key: a row is shuffled for each key."""
    return signed.select("query_id", F.explode(keys).alias("key"), F.struct("arrival", *columns).alias("x"))


def _pairs_by_keys(signed: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(query_id, a, b): each pair of listings that a key brings together and nothing in the keys forbids, once."""
    columns = ["sku_key", "model_tokens"]
    met = _met(_keyed(signed, block_keys(threshold, True), *columns), _keyed(signed, block_keys(threshold, False), *columns), hot).filter("sa.arrival < sb.arrival")
    kind, token = _kind_and_token()
    first = F.array_min(F.array_intersect("sa.model_tokens", "sb.model_tokens")) == token
    pairs = met.filter(kind.isin("e", "s") | (~_same("sku_key") & ((kind == "q") | first))).select("query_id", F.col("sa.arrival").alias("a"), F.col("sb.arrival").alias("b"))
    if 0.10 < threshold <= 0.40:
        ranked = _with_prefix(signed, threshold)
        columns = ["sku_key", "name_tokens"]
        met = _met(_keyed(ranked, block_keys(threshold, True, True), *columns, "prefix"), _keyed(ranked, block_keys(threshold, False, False), *columns), hot)
        size_a, size_b, a, b = F.size("sa.name_tokens"), F.size("sb.name_tokens"), F.col("sa.arrival"), F.col("sb.arrival")
        smaller = (size_a < size_b) | ((size_a == size_b) & (a < b))
        first = F.get(F.filter("sa.prefix", lambda t: F.array_contains("sb.name_tokens", t)), F.lit(0)) == token
        pairs = pairs.unionByName(met.filter(smaller & first & ~_same("sku_key")).select("query_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return pairs


def _arrivals(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", F.col("sa.arrival").alias("a"), F.col("sb.arrival").alias("b"))


def candidates(signed: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, at_once: int = AT_ONCE) -> DataFrame:
    """(query_id, a, b): arrivals a < b of listings that may reach the threshold."""
    small, large = _by_size(signed, at_once)
    found = _arrivals(_side_by_side(small, _may_reach(threshold)))
    return found if large is None else found.unionByName(_pairs_by_keys(large, threshold, hot))


def blocked(signed: DataFrame, hot: int = HOT, at_once: int = AT_ONCE) -> DataFrame:
    """(query_id, a, b): arrivals a < b of all listings of a query that share an EAN, a SKU or a model token, whatever else forbids them; each pair once."""
    small, large = _by_size(signed, at_once)
    found = _arrivals(_side_by_side(small, _same("ean_key") | _same("sku_key") | F.arrays_overlap("sa.model_tokens", "sb.model_tokens")))
    if large is None:
        return found
    one = lambda sign, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(sign), c))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(one("e", "ean_key"), one("s", "sku_key"), F.transform("model_tokens", lambda t: F.concat(F.lit("m"), t)))
    side = _keyed(large, keys, "ean_key", "sku_key", "model_tokens")
    kind, token = _kind_and_token()
    first = F.array_min(F.array_intersect("sa.model_tokens", "sb.model_tokens")) == token
    met = _met(side, side, hot).filter("sa.arrival < sb.arrival").filter((kind == "e") | (~_same("ean_key") & ((kind == "s") | (~_same("sku_key") & first))))
    return found.unionByName(_arrivals(met))


def scored_pairs(signed: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, at_once: int = AT_ONCE) -> DataFrame:
    """(query_id, a, b, score, basis) of all compatible candidate pairs."""
    small, large = _by_size(signed, at_once)
    pairs = _side_by_side(small, _may_reach(threshold))
    if large is not None:
        of = lambda arrival, name: large.select("query_id", F.col("arrival").alias(arrival), F.struct("arrival", *SIGNATURE).alias(name))
        pairs = pairs.unionByName(_pairs_by_keys(large, threshold, hot).join(of("a", "sa"), ["query_id", "a"]).join(of("b", "sb"), ["query_id", "b"]).select("query_id", "sa", "sb"))
    judged = pairs.withColumn("v", verdict("sa", "sb")).filter("v IS NOT NULL")
    return judged.select("query_id", F.col("sa.arrival").alias("a"), F.col("sb.arrival").alias("b"), "v.score", "v.basis")


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(query_id, arrival, component): listings joined by pairs, named by their smallest arrival. Minimum labels that also jump."""
    both = pairs.select("query_id", "a", "b").unionByName(pairs.select("query_id", F.col("b").alias("a"), F.col("a").alias("b")))
    both = _written(both, "pairs")
    labels = _written(both.groupBy("query_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select("query_id", F.col("a").alias("b"), F.col("l").alias("near")), ["query_id", "b"]).groupBy("query_id", "a").agg(F.min("near").alias("near"))
        jump = labels.select("query_id", F.col("a").alias("l"), F.col("l").alias("further"))
        following = labels.join(seen, ["query_id", "a"]).join(jump, ["query_id", "l"], "left").select("query_id", "a", F.least("l", "near", "further").alias("l"))
        following = _written(following, "labels")
        moved = following.withColumnRenamed("l", "m").join(labels, ["query_id", "a"]).filter("l != m").limit(1).count()
        labels = following
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("query_id", F.col("a").alias("arrival"), F.col("l").alias("component"))


#: Queries of more links than this are assigned component by component.
LINKS_AT_ONCE = 1_000_000


def assigned(links: DataFrame) -> DataFrame:
    """First-fit assignment of listings with links (query_id, unit, a, b, score, basis): query_id, arrival, head, place, confidence and basis of its cluster."""
    made = "query_id string, arrival long, head long, place int, confidence double, basis int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: tuple | None = None
        head: dict[int, int] = {}  # a listing's cluster, named by its first member
        state: dict[int, list] = {}  # of a cluster: size, confidence, basis
        place: dict[int, int] = {}
        now: int | None = None
        open_: dict[int, list] = {}  # of the present listing: links, sum of scores and least basis by cluster

        def settle() -> None:
            best = None
            for h, (n, total, basis) in open_.items():
                if n == state[h][0] and (best is None or (total / n, -h) > best[:2]):
                    best = (total / n, -h, basis, h)
            if best is None:
                alone(now)
            else:
                mean, _, basis, h = best
                head[now], place[now] = h, state[h][0]
                state[h] = [state[h][0] + 1, min(state[h][1], mean), min(state[h][2], basis)]

        def alone(x: int) -> None:
            head[x], place[x], state[x] = x, 0, [1, 1.0, NAME]

        def out() -> pa.RecordBatch:
            settle()
            cols = [[unit[0]] * len(head), list(head), list(head.values()), [place[x] for x in head], [state[h][1] for h in head.values()], [state[h][2] for h in head.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()), strict=True)], [x.split()[0] for x in made.split(", ")])

        for batch in batches:
            for q, u, a, b, score, basis in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q, u) != unit:
                    if unit is not None:
                        yield out()
                    unit, now = (q, u), None
                    head, state, place = {}, {}, {}
                if b != now:
                    if now is not None:
                        settle()
                    now, open_ = b, {}
                if a not in head:
                    alone(a)
                link = open_.setdefault(head[a], [0, 0.0, NAME])
                link[0] += 1
                link[1] += score
                link[2] = min(link[2], basis)
        if unit is not None:
            yield out()

    ordered = links.select("query_id", "unit", "a", "b", "score", "basis").repartition("query_id", "unit").sortWithinPartitions("query_id", "unit", "b", "a")
    return ordered.mapInArrow(run, made)


def clusters(signed: DataFrame, threshold: float = THRESHOLD, links_at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """Every listing's cluster: query_id, arrival, head (its first listing), place in it, confidence, basis."""
    pairs = _written(scored_pairs(signed, threshold).filter(F.col("score") >= threshold), "scored")
    units = pairs.withColumn("unit", F.lit(0).cast("long"))
    large = _written(pairs.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") > links_at_once).select("query_id"), "large")
    if not large.isEmpty():
        some = pairs.join(large, "query_id", "left_semi")
        of = components(some).select("query_id", F.col("arrival").alias("a"), F.col("component").alias("unit"))
        units = units.join(large, "query_id", "left_anti").unionByName(some.join(of, ["query_id", "a"]).select(*units.columns))
    found = _written(assigned(units), "assigned")
    alone = signed.join(found, ["query_id", "arrival"], "left_anti").select("query_id", "arrival", F.col("arrival").alias("head"), F.lit(0).alias("place"), F.lit(1.0).alias("confidence"), F.lit(NAME).alias("basis"))
    return found.unionByName(alone)


def groups(signed: DataFrame, threshold: float = THRESHOLD, multi_only: bool = False) -> DataFrame:
    """Product groups with their offers by price; most retailers first, then cheapest, then first seen."""
    signed = _written(signed, "signed")
    rows = signed.join(clusters(signed, threshold), ["query_id", "arrival"])
    richness = F.col("screen_inches").isNotNull().cast("int") + F.col("capacity_gb").isNotNull().cast("int") + F.col("brand_key").isNotNull().cast("int")
    attributes = F.struct(F.col("brand_key").alias("brand"), "screen_inches", "capacity_gb", "qualifiers", "kind")
    offer = F.struct("price_euro", "place", "source", "id", "name", "url", "in_stock")
    per = rows.groupBy("query_id", "head").agg(
        F.min_by("name", F.struct(F.octet_length("name"), F.col("place"))).alias("name"),
        F.max_by(attributes, F.struct(richness, F.col("place"))).alias("attributes"),
        F.count_distinct("source").alias("retailer_count"),
        F.count("*").alias("offer_count"),
        F.min("price_euro").alias("cheapest"),
        F.max("price_euro").alias("highest"),
        F.max("confidence").alias("confidence"),
        F.min("basis").alias("basis"),
        F.sort_array(F.collect_list(offer)).alias("offers"),
    )
    per = per.withColumn("savings", F.greatest(F.col("highest") - F.col("cheapest"), F.lit(0.0))).withColumn("basis", basis_label(F.col("basis")))
    if multi_only:
        per = per.filter("retailer_count > 1")
    return per.orderBy("query_id", F.desc("retailer_count"), "cheapest", "head")
