"""Mixing sources to target weights: hash-threshold histograms (DataFrame functions only).

Every document has a hash of its id and text. Sizes are summed by source and hash bucket; per source the
bucket is found in which the running sum passes the budget; only that bucket is split further (``LEVELS``
times ``BITS`` bits), until the threshold is exact to ``2**-36`` of the hash range. A document whose hash is
below its source's threshold is taken (once more); a second threshold, for documents short enough, fills what is left. Nothing is sorted but histograms of at most ``2**BITS``
buckets a source; what is shuffled are partial sums by source and bucket.

The first thresholds nest: a larger budget of a source takes by hash what a smaller one takes by hash, and more. The filling doesn't: what is short
enough depends on what is left of the budget.

Defined results: a null text has size 0; null sources form one source, the last; rows that repeat (same id
and text) share their hash and are taken together or not at all; a source of size 0 has target 0;
an empty table gives an empty result. ``doc_id`` may be null.

The table of sources (a row for each source name, with its sum) is ranked in one window: the weights follow the
order of the names, and there is one row for each name, however many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_or_plain, staged, whole_text

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BITS, LEVELS = 12, 3
#: A table of thresholds of at most so many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def size_of(docs: DataFrame) -> Column:
    return F.regexp_count(whole_text(docs), F.lit(WORD)).cast("long")


def hash_of(docs: DataFrame) -> Column:
    """The upper BITS * LEVELS bits of the hash of a row's id and text, as a non-negative number."""
    return F.shiftrightunsigned(F.xxhash64(docs["doc_id"], whole_text(docs)), 64 - BITS * LEVELS)


def targets(totals: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """(source, source_size) with ``target``: weights in turn over the sources by code point, null last, capped at ``most`` times the size.

    A capped source stays capped as the others' share grows, so the shares are ``level * weight`` with one level for
    all that are below their cap: sources are ordered by cap per weight, and the level is the one at which the budget fits.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = totals.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    everything, before = Window.partitionBy(), by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    place = F.row_number().over(by_cap)
    fits = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct("_place", "_level"))).over(everything)["_level"]
    return ranked.withColumn("_level", level).withColumn("_place", place).withColumn("_fits", fits).select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_fits") * F.col("_weight"), F.col("_cap"))).alias("target"))


def _threshold(sized: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """(_source, at, used, spill): the threshold per source up to which hashes take at most ``budget``, what they take, and by how much the next one is too long.

    ``nearest``: the last bucket is taken too if that comes nearer to the budget.
    """
    open_at = budgets.select(F.col("source").alias("_source"), F.col("budget").alias("_rest"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("used"), F.lit(None).cast("double").alias("spill"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        here = sized.withColumn("_digits", F.shiftrightunsigned("hash", BITS * (LEVELS - 1 - level))).withColumn("_above", F.shiftright("_digits", BITS))
        bounds = small_or_plain(open_at, BROADCAST_SOURCES)
        # only the bucket at the border is split further
        inside = here.join(bounds, here["source"].eqNullSafe(bounds["_source"]) & (here["_above"] == bounds["_prefix"]), "left_semi")
        sums = inside.groupBy("source", "_digits").agg(F.sum("size").alias("_sum"))
        grown = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("source").orderBy("_digits"))).withColumnRenamed("source", "_found")
        passed = grown.join(bounds, grown["_found"].eqNullSafe(bounds["_source"])).filter(F.col("_upto") > F.col("_rest"))
        before = F.col("_upto") - F.col("_sum")
        over = F.lit(last and nearest) & (F.col("_upto") - F.col("_rest") < F.col("_rest") - before)
        step = F.struct((F.col("_digits") + over.cast("long")).alias("digits"), F.when(over, F.col("_upto")).otherwise(before).alias("used"), (F.col("_upto") - F.col("_rest")).cast("double").alias("spill"))
        first = passed.groupBy("_found").agg(F.min_by(step, F.col("_digits")).alias("at"))
        if not level:  # a source whose sum stays below its budget is taken whole
            whole = sums.groupBy(F.col("source").alias("_all")).agg(F.sum("_sum").alias("_total"))
            open_at = open_at.join(whole, open_at["_source"].eqNullSafe(whole["_all"]), "left").drop("_all")
        following = open_at.join(first, open_at["_source"].eqNullSafe(first["_found"]), "left")
        digits = F.coalesce(F.col("at.digits"), F.shiftleft(F.col("_prefix") + 1, BITS) if level else F.lit(1 << BITS).cast("long"))
        used = F.coalesce(F.col("at.used"), F.lit(0) if level else F.col("_total"), F.lit(0))
        open_at = staged(following.select("_source", (F.col("_rest") - used).alias("_rest"), digits.alias("_prefix"), (F.col("used") + used).cast("double").alias("used"), F.col("at.spill").alias("spill")), f"mix-level{level}")
    return open_at.select("_source", F.col("_prefix").alias("at"), "used", "spill")


def plan(sized: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """From (source, size, hash): source, source_size, target, rounds (whole takes), below, upto and fits.

    A document is taken ``rounds`` times, once more if its hash is below ``below``, or if it is below ``upto`` and the size at
    most ``fits``: the second threshold fills what the document at the border of the first one was too long for.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(totals, weights, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = staged(aims.withColumn("rounds", rounds.cast("long")).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "mix-aims")
    first = _threshold(sized, aims, nearest=False)
    left = staged(aims.join(first, aims["source"].eqNullSafe(first["_source"])).select("source", "source_size", "target", "rounds", F.col("at").alias("below"), (F.col("budget") - F.col("used")).alias("budget"), "spill"), "mix-left")
    bounds = small_or_plain(left.select(F.col("source").alias("_source"), "below", "budget"), BROADCAST_SOURCES)
    shorter = sized.join(bounds, sized["source"].eqNullSafe(bounds["_source"])).filter("hash >= below AND size <= budget").select("source", "size", "hash")
    second = _threshold(shorter, left, nearest=True)
    second = second.select("_source", F.col("at").alias("upto"), F.col("used").alias("filled"))
    nearer = F.coalesce(F.col("spill") < F.abs(F.col("budget") - F.col("filled")), F.lit(False))  # the document at the border comes nearer than the filling
    columns = [(F.col("below") + nearer.cast("long")).alias("below"), F.when(nearer, F.lit(0).cast("long")).otherwise(F.col("upto")).alias("upto"), F.col("budget").alias("fits")]
    return staged(left.join(second, left["source"].eqNullSafe(second["_source"])).select("source", "source_size", "target", "rounds", *columns), "mix-plan")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every document, written once."""
    return staged(docs.select("doc_id", docs["source"].cast("string").alias("source"), size_of(docs).alias("size"), hash_of(docs).alias("hash")), "mix-sizes")


def with_takes(sized: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds source_size, target and ``takes`` (how often the mix has the document) to rows with source and hash."""
    bounds = small_or_plain(thresholds.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
    more = (F.col("hash") < F.col("below")) | ((F.col("hash") < F.col("upto")) & (F.col("size") <= F.col("fits")))
    joined = sized.join(bounds, sized["source"].eqNullSafe(bounds["_source"]), "left")
    return joined.withColumn("takes", F.col("rounds") + (more & (F.col("target") > F.col("rounds") * F.col("source_size"))).cast("long")).drop("_source", "rounds", "below", "upto", "fits", "hash")


def mix(docs: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """The mixed documents with their own columns, each as often as the mix takes it."""
    thresholds = plan(measured(docs), weights, most)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["source"].cast("string").alias("source"), size_of(docs).alias("size"), hash_of(docs).alias("hash"))
    taken = with_takes(rows, thresholds).filter("takes > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("takes"))).alias("_take")).select("_row.*")
