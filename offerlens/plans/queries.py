"""One query for each operator over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import shared_dir
from ..functions import scalars as S
from ..functions import text as T
from ..operators import alerts as A
from ..operators import history as H
from ..operators import matching as M
from ..operators import trigrams
from ..operators.filters import Filters, apply_filters, dropped_count
from ..operators.identity import signature
from ..operators.ledger import Ledger
from ..operators.stored import Stored
from ..sources import registry
from .tables import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(name: str):
    return F.concat_ws("|", name).alias(name)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a check-digited EAN on some rows."""
    t = view(spark, sf_dir, "titles")
    digit = F.expr("(10 - aggregate(transform(sequence(1, 12), i -> cast(substr(ean0, i, 1) AS int) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END), 0, (a, x) -> a + x) % 10) % 10")
    return t.withColumn("ean", F.when(F.length("ean0") == 12, F.concat("ean0", digit.cast("string"))).otherwise(F.col("ean0"))).drop("ean0")


def signed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature(titles(spark, sf_dir))


@query
def latest_price(spark, sf_dir):
    return H.latest(view(spark, sf_dir, "offers"))


@query
def price_spread_by_product(spark, sf_dir):
    return H.spread(H.latest(view(spark, sf_dir, "offers")))


@query
def cheapest_offer_list(spark, sf_dir):
    latest = H.latest(view(spark, sf_dir, "offers"))
    offers = F.sort_array(F.collect_list(F.struct("price_euro", "source")))
    return latest.groupBy("product_id").agg(F.array_join(F.transform(offers, lambda o: o["source"]), ">").alias("by_price"), F.element_at(offers, 1)["price_euro"].alias("cheapest"))


@query
def price_history_topn(spark, sf_dir):
    return H.newest(view(spark, sf_dir, "offers"), 3).select("product_id", "source", "price_euro", "recorded_at", "seq", "rank")


@query
def price_history_of_product(spark, sf_dir):
    return H.history_of(view(spark, sf_dir, "offers"), "7", "src3").select("product_id", "source", "price_euro", "in_stock", "recorded_at", "seq")


@query
def price_history_oldest_first(spark, sf_dir):
    """The newest 30 points of the product and source with the most, in the order in which they came; ``turn`` is that order."""
    points = H.changes(view(spark, sf_dir, "sightings"), 50.0)
    most = points.groupBy(*H.KEY).count().orderBy(F.desc("count"), *H.KEY).first()
    found = H.history_of(points, most.product_id, most.source, 30, oldest_first=True) if most else points.limit(0)
    return found.select(*H.KEY, "seq", "price_euro").withColumn("turn", F.row_number().over(Window.orderBy("seq")))


@query
def store_search_postings(spark, sf_dir):
    """Patterns over the store by postings of trigrams: literal parts, wildcards, an id, and one too short to be looked up."""
    products = H.products(view(spark, sf_dir, "sightings"))
    path = shared_dir(spark, "postings")
    trigrams.write(products, path, 32)
    rows = spark.read.parquet(path)
    found = [trigrams.search(products, rows, q, limit=40, buckets=32).select(F.lit(q).alias("query"), "product_id", "source", "name") for q in ("AME 1", "na_e%12", "7", "e 3", "none such")]
    together = found[0]
    for f in found[1:]:
        together = together.unionByName(f)
    return together


@query
def change_only_history(spark, sf_dir):
    return H.changes(view(spark, sf_dir, "sightings"), 50.0).select("product_id", "source", "seq", "price_euro", "in_stock")


@query
def incremental_history(spark, sf_dir):
    """The change-only history, folded in four batches by time into a ledger, with a compaction between."""
    rows = view(spark, sf_dir, "sightings")
    ledger = Ledger(spark, shared_dir(spark, "ledger"), buckets=8, tolerance=50.0)
    ends = rows.agg(F.percentile(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).first().p
    turn = sum((F.unix_micros(F.col("recorded_at").cast("timestamp")) > e).cast("int") for e in ends or []) if ends else F.lit(0)
    for n in range(4):
        ledger.fold(rows.filter(turn == n), n)
        if n == 1:
            ledger.compact()
    return ledger.points.select("product_id", "source", "seq", "price_euro", "in_stock")


@query
def product_upsert(spark, sf_dir):
    return H.products(view(spark, sf_dir, "sightings"))


@query
def store_search(spark, sf_dir):
    return H.search(H.products(view(spark, sf_dir, "sightings")), "AME 1").select("product_id", "source", "name")


@query
def store_stats(spark, sf_dir):
    s = view(spark, sf_dir, "sightings")
    return H.stats(s.select("product_id", "source").distinct(), s, A.tracked(view(spark, sf_dir, "actions")))


@query
def stats_by_source(spark, sf_dir):
    return H.by_source(view(spark, sf_dir, "offers"))


@query
def tracked(spark, sf_dir):
    return A.tracked(view(spark, sf_dir, "actions"))


@query
def alerts(spark, sf_dir):
    return A.alerts(view(spark, sf_dir, "actions"))


def _known(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    offers = view(spark, sf_dir, "offers")
    named = offers.select("product_id", "source").distinct().select("product_id", "source", F.concat(F.lit("product "), "product_id").alias("name"), F.concat(F.lit("https://example.org/"), "source").alias("url"))
    return named, H.latest(offers)


@query
def alerts_report(spark, sf_dir):
    return A.report(A.alerts(view(spark, sf_dir, "actions")), *_known(spark, sf_dir))


@query
def alerts_report_stored(spark, sf_dir):
    """The same over tables that share their partitioning."""
    latest = H.latest(view(spark, sf_dir, "offers"))
    known = latest.select(*H.KEY, F.concat(F.lit("product "), "product_id").alias("name"), F.concat(F.lit("https://example.org/"), "source").alias("url"))
    store = Stored(spark, shared_dir(spark, "stored"), f"alerts_{uuid.uuid4().hex}", buckets=8)
    for name, rows in (("actions", view(spark, sf_dir, "actions")), ("products", known), ("latest", latest)):
        store.write(name, rows)
    return store.report()


@query
def alerts_triggered(spark, sf_dir):
    return A.report(A.alerts(view(spark, sf_dir, "actions")), *_known(spark, sf_dir)).filter("triggered").select("product_id", "source", "current_price", "target_price")


@query
def tracked_report(spark, sf_dir):
    return A.tracked_report(A.tracked(view(spark, sf_dir, "actions")), *_known(spark, sf_dir))


@query
def fold_text(spark, sf_dir):
    return titles(spark, sf_dir).select("id", T.expand_inch_marks(T.fold(F.col("name"))).alias("folded"))


@query
def tokenize(spark, sf_dir):
    return titles(spark, sf_dir).select("id", F.array_join(T.tokens(T.expand_inch_marks(T.fold(F.col("name")))), " ").alias("tokens"))


@query
def signature_sets(spark, sf_dir):
    return signed_titles(spark, sf_dir).select("id", joined("spec_tokens"), joined("model_tokens"), joined("name_tokens"), joined("qualifiers"))


@query
def attributes(spark, sf_dir):
    return signed_titles(spark, sf_dir).select("id", "kind", "screen_inches", "capacity_gb", "brand_key")


@query
def described_attributes(spark, sf_dir):
    s = signed_titles(spark, sf_dir)
    return s.select("id", S.described(F.col("screen_inches"), F.col("capacity_gb"), F.col("qualifiers"), F.col("kind")).alias("words"))


@query
def gtin_normalize(spark, sf_dir):
    return titles(spark, sf_dir).withColumn("other", F.when(F.col("arrival") % 2 == 0, F.substring("ean", 2, 12)).otherwise(F.concat(F.lit("1"), "ean"))).select("id", "ean", T.gtin("ean").alias("gtin"), T.gtin("other").alias("gtin_other"))


@query
def sku_brand_normalize(spark, sf_dir):
    return titles(spark, sf_dir).select("id", T.sku(F.col("sku")).alias("sku_key"), T.brand(F.col("brand")).alias("brand_key"))


def _filtered(name: str, filters: Filters) -> None:
    def run(spark, sf_dir):
        return apply_filters(titles(spark, sf_dir), filters).select("id")

    QUERIES[name] = run


_filtered("filter_price", Filters(min_price=950.0, max_price=1500.0))
_filtered("filter_stock", Filters(in_stock_only=True))
_filtered("filter_devices", Filters(devices_only=True))
_filtered("filter_brand", Filters(brand="Samsung"))
_filtered("filter_inches", Filters(min_inches=20, max_inches=40))
_filtered("filter_noop", Filters())


@query
def filter_dropped_count(spark, sf_dir):
    return dropped_count(titles(spark, sf_dir), Filters(max_price=1000.0, in_stock_only=True, min_inches=10))


@query
def blocking_candidates(spark, sf_dir):
    return M.blocked(signed_titles(spark, sf_dir))


@query
def pair_scores(spark, sf_dir):
    return M.scored_pairs(signed_titles(spark, sf_dir)).select("query_id", "a", "b", "score", S.basis_label(F.col("basis")).alias("basis"))


@query
def match_groups(spark, sf_dir):
    g = M.groups(signed_titles(spark, sf_dir))
    return g.select("query_id", "head", "name", "retailer_count", "offer_count", "cheapest", "highest", "savings", "confidence", "basis", F.array_join(F.transform("offers", lambda o: o["id"]), ",").alias("members"))


@query
def group_attributes(spark, sf_dir):
    """The richest attributes of each group's members."""
    g = M.groups(signed_titles(spark, sf_dir))
    return g.select("query_id", "head", "attributes.brand", "attributes.screen_inches", "attributes.capacity_gb", F.array_join("attributes.qualifiers", ",").alias("qualifiers"), "attributes.kind")


@query
def match_groups_multi(spark, sf_dir):
    return M.groups(apply_filters(signed_titles(spark, sf_dir), Filters(devices_only=True)), multi_only=True).select("query_id", "head", "retailer_count", "cheapest")


@query
def parse_price(spark, sf_dir):
    return view(spark, sf_dir, "prices").select("seq", S.price(F.col("raw_price")).alias("price_euro"))


@query
def parse_stock(spark, sf_dir):
    return view(spark, sf_dir, "prices").select("seq", S.stock(F.col("raw_stock")).alias("in_stock"))


@query
def absolute_url(spark, sf_dir):
    return view(spark, sf_dir, "prices").select("seq", S.absolute_url(F.lit("https://x.fi/"), F.col("href")).alias("url"))


@query
def price_stock_labels(spark, sf_dir):
    return view(spark, sf_dir, "offers").select("seq", S.price_label(F.floor("price_euro").cast("double")).alias("price"), S.stock_label(F.col("in_stock")).alias("stock"), S.yes_no(F.col("in_stock").eqNullSafe(True)).alias("yes"))


@query
def squeeze_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", S.squeeze(F.col("text")).alias("squeezed"))


@query
def url_ids(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.concat(F.lit("https://example.org/product/"), "page_id", F.lit("/p-"), "page_id", F.lit("/x?y=1"))
    columns = [S.url_id(F.lit(s), url).alias(f"id_{s}") for s in ("verkkokauppa", "power", "proshop")]
    return pages.select("page_id", *columns, S.url_id(F.lit("proshop"), F.col("url")).alias("id_segment"))


@query
def url_encode(spark, sf_dir):
    return titles(spark, sf_dir).select("id", S.url_encoded(F.col("name")).alias("encoded"))


@query
def source_resolve(spark, sf_dir):
    known = registry.sources(spark).select("id", "rank")
    named = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.element_at(F.array(*map(F.lit, (" JIMMS ", "www.power.fi", "proshop.fi", "amazon", "", "Gigantti"))), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("raw"))
    return named.join(F.broadcast(known), S.source_key(F.col("raw")) == known["id"], "left").select("s_suppkey", "raw", F.col("id").alias("source"))


@query
def sources_catalog(spark, sf_dir):
    """The searchable retailers, and how many suppliers go by their name, id or domain."""
    named = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.element_at(F.array(*map(F.lit, (" JIMMS ", "www.power.fi", "proshop.fi", "amazon", "", "Gigantti"))), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("raw"))
    counts = named.groupBy(S.source_key(F.col("raw")).alias("id")).agg(F.count("*").alias("suppliers"))
    listed = registry.searchable(spark).join(counts, "id", "left")
    return listed.select("rank", "id", "name", "domain", "page_cap", "disallowed", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query
def fan_out_union(spark, sf_dir):
    t = titles(spark, sf_dir)
    parts = [t.filter(F.col("source") == f"src{i}") for i in range(7)]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return together.groupBy("source").agg(F.count("*").alias("n"), F.sum("arrival").alias("arrivals"))


@query
def per_source_limit(spark, sf_dir):
    return H.first_by_source(titles(spark, sf_dir), 2).select("query_id", "source", "arrival")


@query
def enrich_missing(spark, sf_dir):
    from ..sources.parsers import enrich

    t = titles(spark, sf_dir)
    pages = t.filter("arrival % 4 != 3").select("source", "id", F.when(F.col("arrival") % 5 != 0, F.concat(F.lit("e"), "id")).alias("ean"), F.when(F.col("arrival") % 8 == 0, F.concat(F.lit("s"), "id")).alias("sku"), F.lit("brand").alias("brand"))
    return enrich(t, pages).select("query_id", "arrival", "ean", "sku", "brand", "enriched")


def _replies(parts, source, kind, body):
    keyed = parts.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.col("p_partkey").cast("string").alias("request_key"), F.when(F.col("p_partkey") % 11 == 0, 404).otherwise(200).alias("status"), F.lit("").alias("final_url"), F.create_map().cast("map<string,string>").alias("headers"), body.alias("body"))
    return keyed


_LISTED = ("id", "name", "price_euro", "url", "image_url", "in_stock", "ean", "sku", "brand")


@query
def verkkokauppa_product_replies(spark, sf_dir):
    from ..sources.parsers import verkkokauppa_products

    key, lang = F.col("p_partkey"), lambda c: F.struct(F.when(key % 3 != 0, c).alias("fi"), F.concat(F.lit("en "), c).alias("en"))
    item = F.struct(
        key.alias("pid"), lang(F.col("p_name")).alias("name"), F.struct(F.when(key % 3 != 0, F.concat(F.lit("/p/"), key)).alias("fi"), F.concat(F.lit("/en/"), key).alias("en")).alias("href"), F.struct(F.when(key % 7 != 0, F.col("p_retailprice")).alias("current")).alias("price"), F.array(F.lit(" "), F.concat(F.lit("e"), key)).alias("eans"),
        F.array(F.concat(F.lit("m"), key), F.lit("x")).alias("mpns"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.struct(F.lit("small").alias("45"), F.concat(F.lit("large"), key).alias("800"), F.lit("none").alias("big")).alias("images"),
    )
    replies = _replies(spark.read.parquet(f"{sf_dir}/part.parquet"), "verkkokauppa", "product", F.when(key % 13 == 0, "[]").otherwise(F.to_json(F.array(item))))
    return verkkokauppa_products(replies).select(*_LISTED)


def _power_items(key):
    named = F.struct(
        key.alias("productId"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"), F.when(key % 3 != 0, F.concat(F.lit("/x/p-"), key, F.lit("/"))).alias("url"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("manufacturerName"),
        F.when(key % 2 == 0, F.concat(F.lit("u"), key)).alias("eanGtin12"), F.concat(F.lit("b"), key).alias("barcode"), F.col("p_type").alias("productManufactorIdentity"), F.when(key % 5 == 0, "OutOfStock").otherwise("InStock").alias("webStockMeta"),
        F.struct(F.lit("/img").alias("basePath"), F.array(F.struct(F.lit("s.jpg").alias("filename"), F.lit(100).alias("width")), F.struct(F.lit("l.jpg").alias("filename"), F.lit(600).alias("width"))).alias("variants")).alias("productImage"),
    )
    return F.array(named.withField("title", F.lit(" ")).withField("productId", key + 1_000_000), named)


@query
def power_product_replies(spark, sf_dir):
    from ..sources.parsers import power_products

    key = F.col("p_partkey")
    return power_products(_replies(spark.read.parquet(f"{sf_dir}/part.parquet"), "power", "product", F.when(key % 13 == 0, "no JSON").otherwise(F.to_json(_power_items(key))))).select(*_LISTED)


@query
def power_search_replies(spark, sf_dir):
    from ..sources.parsers import power_search

    key = F.col("p_partkey")
    return power_search(_replies(spark.read.parquet(f"{sf_dir}/part.parquet"), "power", "search", F.to_json(F.struct(_power_items(key).alias("products"))))).select("query_id", "rank", *_LISTED)


@query
def jimms_search_replies(spark, sf_dir):
    from ..sources.parsers import jimms_search

    key = F.col("p_partkey")
    item = F.struct(key.alias("ProductID"), F.col("p_type").alias("Code"), F.lit("Acme").alias("VendorName"), F.concat(F.lit("Acme "), "p_name").alias("Name"), F.col("p_retailprice").alias("PriceTax"), F.when(key % 3 != 0, F.concat(F.lit("Product/"), key)).alias("Uri"), key.alias("ImageID"), F.lit("https://i/").alias("ImageBaseSrc"))
    reply = F.struct((key % 7 == 0).alias("IsError"), F.lit("down").alias("ErrorMessage"), F.array(item).alias("Products"))
    return jimms_search(_replies(spark.read.parquet(f"{sf_dir}/part.parquet"), "jimms", "search", F.to_json(reply))).select("id", "name", "price_euro", "url", "image_url", "sku", "brand")


@query
def backoff_schedule(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("attempt"), F.when(F.col("n_nationkey") % 5 == 4, F.col("n_nationkey") * 3).alias("retry_after"), (F.col("n_regionkey") / 4.0).alias("jitter"))
    return n.select("attempt", S.backoff(F.col("attempt"), F.col("retry_after"), F.col("jitter"), 1.0, 20.0).alias("seconds"))


@query
def delays(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", S.delay_seconds(F.col("s_acctbal")).alias("seconds"))


@query
def events_json_props(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query
def page_titles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query
def refresh_outcome(spark, sf_dir):
    """Tracked products against the newest payload: updated, or an error row."""
    latest = H.latest(view(spark, sf_dir, "offers"))
    rows = A.tracked(view(spark, sf_dir, "actions")).join(latest, H.KEY, "left")
    gone = F.col("price_euro").isNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(~gone).alias("updated"), F.count_if(gone).alias("errors"))
