"""Matching, filters, history, alerts, parsers, streaming and the façade."""

import json
import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.api import Engine
from offerlens.operators import alerts as A
from offerlens.operators import history as H
from offerlens.operators import matching as M
from offerlens.operators.filters import Filters, apply_filters, dropped_count
from offerlens.operators.identity import signature
from offerlens.sources import jsonld, parsers
from offerlens.streaming import sightings as stream

LISTING = "query_id string, arrival long, id string, name string, price_euro double, source string, url string, in_stock boolean, ean string, sku string, brand string"


def listings(spark, rows):
    full = [("q", i, str(i), r[0], r[1], r[2], f"https://example.org/{i}", r[4] if len(r) > 4 else True, r[3] if len(r) > 3 else None, None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LISTING)


def pair(spark, a, b, ean_a=None, ean_b=None):
    s = signature(listings(spark, [(a, 1.0, "x", ean_a), (b, 1.0, "y", ean_b)]))
    x = s.filter("arrival = 0").select(F.struct(*M.SIGNATURE).alias("a"))
    row = x.join(s.filter("arrival = 1").select(F.struct(*M.SIGNATURE).alias("b"))).select(M.verdict().alias("v")).first()
    return None if row.v is None else (row.v.score, row.v.basis)


E1, E2 = "0730143314350", "5032037150354"
START = datetime(2024, 1, 1)


def test_pair_verdicts(spark):
    assert pair(spark, "Anything", "Else", E1, E1) == (1.0, M.EAN)
    assert pair(spark, "Same name 7800X3D", "Same name 7800X3D", E1, E2) is None
    for a, b in [("AMD Ryzen 7 7800X3D", "AMD Ryzen 9 7950X"), ("Samsung 990 PRO 1TB", "Samsung 990 PRO 4 Tt"), ("Samsung 990 PRO 1000 GB", "Samsung 990 PRO 4 Tt"), ("RTX 4070", "RTX 4070 Ti"), ("RTX 4070 Ti", "RTX 4070 Super"), ("Samsung 990 PRO", "Samsung 990 EVO Plus"), ('Samsung 55" U80', 'Samsung 65" U80')]:
        assert pair(spark, a, b) is None, (a, b)
    for a, b in [("Samsung 990 PRO 1 Tt", "Samsung 990 PRO 1TB NVMe"), ('Samsung 65" U8005', "Samsung 65 tuuman U8005"), ("Samsung 9100 PRO 1TB M.2 2280 PCIe x4", "Samsung 9100 PRO 1TB")]:
        assert pair(spark, a, b)[0] >= 0.55, (a, b)


def test_groups(spark):
    rows = [("AMD Ryzen 7 7800X3D", 399.0, "a"), ("Ryzen 7 7800X3D AMD", 379.0, "b"), ("AMD Ryzen 7 7800X3D 4.2 GHz", 419.0, "c"), ("AMD Ryzen 9 7950X", 500.0, "a")]
    got = M.groups(signature(listings(spark, rows))).collect()
    assert [(g.retailer_count, g.cheapest, g.highest, g.savings) for g in got] == [(3, 379.0, 419.0, 40.0), (1, 500.0, 500.0, 0.0)]
    assert got[1].confidence == 1.0 and got[1].basis == "name" and [o.price_euro for o in got[0].offers] == [379.0, 399.0, 419.0]
    assert M.groups(signature(listings(spark, rows[:0]))).collect() == []
    assert [g.retailer_count for g in M.groups(signature(listings(spark, rows)), multi_only=True).collect()] == [3]


def test_clusters_follow_a_plain_model(spark):
    draw = random.Random(8)
    parts = [["Samsung", "WD", "Kingston"], ["990", "980", "SN850X", "KC3000"], ["PRO", "EVO", ""], ["1TB", "2 Tt", "1000GB", ""], ["NVMe", "SSD", "M.2 2280", "jäähdytyssiili"]]
    rows = [(" ".join(draw.choice(p) for p in parts), draw.uniform(1, 9), f"s{i % 5}", draw.choice([None, None, E1, E2])) for i in range(60)]
    signed = signature(listings(spark, rows)).cache()
    pairs = signed.select(F.col("arrival").alias("i"), F.struct(*M.SIGNATURE).alias("a")).join(signed.select(F.col("arrival").alias("j"), F.struct(*M.SIGNATURE).alias("b")), F.col("i") < F.col("j")).select("i", "j", M.verdict().alias("v"))
    scores = {(r.i, r.j): r.v.score for r in pairs.collect() if r.v is not None}
    blocked = {(r.a, r.b): r.score for r in M.scored_pairs(signed).collect()}
    assert {k: v for k, v in scores.items() if v > 0.40} == {k: v for k, v in blocked.items() if v > 0.40}
    ok = lambda a, b: scores.get((min(a, b), max(a, b)), 0) >= 0.55
    groups = []
    for x in range(60):
        best, at = 0, None
        for g in groups:
            if all(ok(x, m) for m in g) and (mean := sum(scores[(m, x)] for m in g) / len(g)) > best:
                best, at = mean, g
        at.append(x) if at is not None else groups.append([x])
    while (hit := next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if all(ok(a, b) for a in groups[i] for b in groups[j])), None)) is not None:
        groups[hit[0]] += groups.pop(hit[1])
    got = defaultdict(list)
    for r in M.clusters(signed).orderBy("place").collect():
        got[r.head].append(r.arrival)
    assert sorted(got.values()) == sorted(groups)


def test_filters(spark):
    rows = listings(spark, [('Samsung 65" TV', 900.0, "a"), ('LG 55" TV', 0.0, "b", None, None), ("Seinäteline", 20.0, "a"), ("TV asennus", 90.0, "b", None, False)])
    ids = lambda f: [r.id for r in apply_filters(rows, f).orderBy("arrival").collect()]
    assert ids(Filters(devices_only=True)) == ["0", "1"] and ids(Filters(min_inches=65)) == ["0"] and ids(Filters(max_inches=60)) == ["1"]
    assert ids(Filters(in_stock_only=True)) == ["0", "2"] and ids(Filters(max_price=20.0)) == ["1", "2"] and ids(Filters(brand="SAMSUNG")) == ["0"] and ids(Filters()) == ["0", "1", "2", "3"]
    assert tuple(dropped_count(rows, Filters(in_stock_only=True)).first()) == (2, 2)


SEEN = "product_id string, source string, price_euro double, in_stock boolean, recorded_at timestamp, seq long, name string, url string, image_url string, ean string, sku string, brand string"


def seen(spark, rows):
    return spark.createDataFrame([("p", "s", p, st) for p, st in rows], "product_id string, source string, price_euro double, in_stock boolean").coalesce(1).withColumn("seq", F.monotonically_increasing_id()).withColumn("recorded_at", F.timestamp_seconds("seq"))


def test_changes(spark):
    kept = lambda rows: [r.seq for r in H.changes(seen(spark, rows)).orderBy("seq").collect()]
    assert kept([(10.0, True), (10.0, True)]) == [0] and kept([(10.0, True), (11.0, True)]) == [0, 1] and kept([(10.0, True), (10.0, None), (10.0, None), (10.0, False)]) == [0, 1, 3]
    assert kept([(0.0, True), (10.0, True), (-1.0, True)]) == [1]
    assert kept([(10.0, True), (10.004, True), (10.008, True)]) == [0, 2]  # drift is kept in time


def test_streamed_changes_follow_the_batch(spark, tmp_path):
    rows = [(float(10 + i // 3), None if i % 5 == 4 else i % 4 > 1) for i in range(30)]
    all_rows = seen(spark, rows)
    for n in range(3):
        all_rows.filter((F.col("seq") >= n * 10) & (F.col("seq") < n * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(all_rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.changes(source).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.seq for r in spark.table("kept").collect()) == [r.seq for r in H.changes(all_rows).orderBy("seq").collect()]


def test_products_keep_what_they_learned(spark):
    rows = [("p", "s", 1.0, True, 1, 1, "old", "u1", "i", "e", None, "b"), ("p", "s", 1.0, True, 2, 2, "new", "u2", None, None, "k", None), ("p", "t", 1.0, True, 2, 3, "other", "u3", None, None, None, None)]
    frame = spark.createDataFrame(rows, SEEN.replace("timestamp", "int")).withColumn("recorded_at", F.timestamp_seconds("recorded_at"))
    got = {r.source: r for r in H.products(frame).collect()}
    assert len(got) == 2 and (got["s"].name, got["s"].url, got["s"].image_url, got["s"].ean, got["s"].sku, got["s"].brand) == ("new", "u2", "i", "e", "k", "b")
    found = lambda q: sorted(r.source for r in H.search(H.products(frame), q).collect())
    assert found("NEW") == ["s"] and found("k") == ["s"] and found("_ew") == ["s"] and found("%") == ["s", "t"] and found("Ñ") == []


def test_alerts(spark):
    events = [("track", 1), ("untrack", 2), ("alert", 3, 20.0), ("alert", 4, 10.0), ("unalert", 5), ("alert", 6, 8.0)]
    frame = lambda n: spark.createDataFrame([(e[0], "p", "s", e[2] if len(e) > 2 else None, e[1], e[1]) for e in events[:n]], "action string, product_id string, source string, target_price double, acted_at int, seq long")
    assert [r.added_at for r in A.tracked(frame(6)).collect()] == [3] and A.tracked(frame(2)).collect() == []
    assert [(r.target_price, r.created_at) for r in A.alerts(frame(4)).collect()] == [(10.0, 3)] and A.alerts(frame(5)).collect() == [] and [r.target_price for r in A.alerts(frame(6)).collect()] == [8.0]
    hit = spark.createDataFrame([(10.0, 10.0), (10.1, 10.0), (0.0, 10.0), (None, 10.0)], "p double, t double").select(A.triggered(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in hit] == [True, False, False, False]


CARD = '<div class="item_wrapper" data-code="K1"><a class="pTitle" href="/fi/products/31/name">WD&nbsp;Black <b>SN850X</b></a><div class="productDataEntry" data-price="359.90" data-brand="WD"></div><div class="product_image"><img src="//cdn.x/i.jpg"></div><div class="product_stock"><span class="greytext">Varastossa</span></div></div>'
LD = '<script type="application/ld+json">oops</script><script type="application/ld+json">{"@graph":[{"@type":["Thing","product"],"name":" TV ","gtin13":"0730143314350","mpn":77,"brand":{"name":"LG"},"image":[{"url":"/i.png"}],"offers":[{"price":"100","availability":"https://schema.org/OutOfStock"},{"price":"124,90","eligibleCustomerType":"PublicUser","availability":"https://schema.org/InStock"}]}]}</script>'


def payloads(spark):
    verkkokauppa = {"data": [{"id": "5", "attributes": {"name": " Disk ", "price": {"current": 10.5}, "images": [{"orig": "i"}], "articles": [{"eans": [" ", "e1"]}]}, "relationships": {"brand": {"data": {"id": "b"}}}}], "included": [{"type": "brands", "id": "b", "attributes": {"name": "X"}}, {"type": "brands", "id": "b", "attributes": {"name": "WD"}}]}
    power = {"products": [{"productId": 9, "title": "Phone", "price": 5.0, "eanGtin12": "", "barcode": "77", "webStockMeta": "instock", "productImage": {"basePath": "/m", "variants": [{"filename": "a", "width": 9}, {"filename": "b", "width": 9}, {"filename": None, "width": 99}]}}]}
    jimms = {"IsError": False, "Products": [{"ProductID": 3, "Code": "c", "VendorName": "Asus", "Name": "Board", "PriceTax": 7.0, "ItemAvailability": 2}]}
    rows = [("verkkokauppa", "search", "q", 200, json.dumps(verkkokauppa)), ("verkkokauppa", "availability", "5", 200, '[{"pid":5,"status":{"schema":"INSTOCK"}}]'), ("power", "search", "q", 200, json.dumps(power)), ("jimms", "search", "q", 200, json.dumps(jimms)), ("jimms", "search", "q2", 200, '{"IsError":true,"ErrorMessage":"bad\\nmore"}'), ("multitronic", "search", "q", 200, CARD), ("multitronic", "product", "31", 200, LD), ("gigantti", "search", "q", 200, ""), ("gigantti", "product", "8", 429, "")]
    return spark.createDataFrame([(s, k, q, c, None, {"X-Vercel-Mitigated": "challenge"} if c == 429 else {}, b) for s, k, q, c, b in rows], "source string, kind string, request_key string, status int, final_url string, headers map<string,string>, body string")


def test_parsers(spark):
    got = {r.source: r for r in parsers.search_listings(payloads(spark)).collect()}
    assert set(got) == {"verkkokauppa", "power", "jimms", "multitronic"}
    v, p, j, m = got["verkkokauppa"], got["power"], got["jimms"], got["multitronic"]
    assert (v.id, v.name, v.price_euro, v.ean, v.brand, v.in_stock, v.url) == ("5", "Disk", 10.5, "e1", "WD", True, "https://www.verkkokauppa.com/fi/product/5")
    assert (p.id, p.ean, p.in_stock, p.image_url) == ("9", None, True, "https://media.power-cdn.net/m/b") and p.url == "https://www.power.fi/p-9/"
    assert (j.name, j.in_stock, j.sku, j.url) == ("Asus Board", False, "c", "https://www.jimms.fi/fi/Product/Show/3")
    assert (m.id, m.name, m.price_euro, m.in_stock, m.sku, m.brand, m.image_url) == ("31", "WD Black SN850X", 359.9, True, "K1", "WD", "https://cdn.x/i.jpg")
    assert sorted(got, key=lambda s: got[s].arrival) == ["verkkokauppa", "power", "jimms", "multitronic"]
    assert {(r.source, r.error) for r in parsers.errors(payloads(spark)).collect()} == {("jimms", "bad"), ("gigantti", "search is not supported"), ("gigantti", "blocked by a bot challenge")}
    assert parsers.search_listings(payloads(spark), 0).collect() == []


def test_product_pages(spark):
    r = parsers.html_products(payloads(spark)).collect()
    assert [(x.id, x.name, x.price_euro, x.ean, x.sku, x.brand, x.in_stock, x.image_url) for x in r] == [("31", "TV", 124.9, E1, "77", "LG", True, "https://www.multitronic.fi/i.png")]
    assert jsonld.find("<p>none</p>") is None
    html = '<h1 class="product_name">Disk</h1><span itemprop="price" content="99,90"></span><div class="stock">Ei varastossa</div><meta itemprop="gtin13" content="1">'
    from offerlens.sources.markup import parse

    page = parsers.product_page("datatronic", parse(html))
    assert (page["name"], page["price"], page["stock"], page["ean"]) == ("Disk", "99,90", "Ei varastossa", "1") and parsers.product_page("proshop", parse(html)) is None


def product_replies(spark, *rows):
    """(source, id, status, final URL, body) of product lookups."""
    return spark.createDataFrame([(s, "product", i, c, u, {}, b) for s, i, c, u, b in rows], "source string, kind string, request_key string, status int, final_url string, headers map<string,string>, body string")


def ld(**fields):
    return '<script type="application/ld+json">' + json.dumps({"@type": "Product", **fields}) + "</script>"


VERKKOKAUPPA_ITEM = {"pid": 853450, "name": {"fi": "Prosessori", "en": "Processor"}, "href": {"fi": "/fi/product/853450/p"}, "price": {"current": 365.99}, "eans": [" ", "0730143314930"], "mpns": ["100-1"], "brand": {"id": "171", "name": "AMD"}, "images": {"45": "s", "800": "l", "x": "n"}}


def test_json_product_replies(spark):
    item = VERKKOKAUPPA_ITEM
    rows = [
        ("verkkokauppa", "a", 200, None, json.dumps([item, item | {"pid": 1}])), ("verkkokauppa", "b", 200, None, json.dumps([{"pid": "7", "name": {"en": "Only English"}, "images": ["first", "second"]}])),
        ("verkkokauppa", "c", 200, None, json.dumps([{"pid": 8, "name": {"fi": "Text"}, "images": "one"}])), ("verkkokauppa", "d", 200, None, "[]"), ("verkkokauppa", "e", 200, None, "garbage"), ("verkkokauppa", "f", 404, None, json.dumps([item])),
        ("verkkokauppa", "g", 200, None, json.dumps([{"name": {"fi": "No id"}}])), ("power", "h", 200, None, json.dumps([{"productId": 3, "title": " "}, {"productId": 4280074, "title": "Thing", "url": "/x/p-4280074/", "price": 10.0, "webStockMeta": "InStock"}])),
        ("power", "i", 200, None, "[]"), ("power", "j", 200, None, "nonsense"),
    ]
    got = {r.query_id: r for r in parsers.product_listings(product_replies(spark, *rows)).collect()}
    assert set(got) == {"a", "b", "c", "h"}
    a, b, h = got["a"], got["b"], got["h"]
    assert (a.id, a.name, a.price_euro, a.url, a.image_url, a.in_stock, a.ean, a.sku, a.brand) == ("853450", "Prosessori", 365.99, "https://www.verkkokauppa.com/fi/product/853450/p", "l", None, "0730143314930", "100-1", "AMD")
    assert (b.id, b.name, b.price_euro, b.url, b.image_url, got["c"].image_url) == ("7", "Only English", 0.0, "https://www.verkkokauppa.com/fi/product/7", "first", "one")
    assert (h.id, h.price_euro, h.in_stock, h.url) == ("4280074", 10.0, True, "https://www.power.fi/x/p-4280074/")


def test_html_product_replies(spark):
    rows = [
        ("proshop", "1", 200, "https://www.proshop.fi/end", ld(name="P", sku="99", image="https:/Images/a.png") + '<meta property="og:image" content="/Images/b.png">'), ("proshop", "2", 200, None, ld(name="Q", image="https:/Images/a.png")),
        ("gigantti", "3", 200, "https://x/y", ld(name="G")), ("gigantti", "4", 200, None, ld(name="H", sku="5", offers={"url": "https://www.gigantti.fi/own"})), ("datatronic", "6", 200, "https://www.datatronic.fi/end", "<h1>D</h1>"),
        ("datatronic", "7", 410, None, "<h1>Gone</h1>"), ("jimms", "8", 500, None, "<h1>Down</h1>"),
    ]
    replies = product_replies(spark, *rows)
    got = {r.query_id: (r.id, r.url, r.image_url) for r in parsers.product_listings(replies).collect()}
    assert got == {
        "1": ("99", "https://www.proshop.fi/end", "https://www.proshop.fi/Images/b.png"), "2": ("2", "https://www.proshop.fi/2", None), "3": ("3", "https://www.gigantti.fi/product/3", None),
        "4": ("5", "https://www.gigantti.fi/own", None), "6": ("6", "https://www.datatronic.fi/end", None),
    }
    assert [(r.query_id, r.error) for r in parsers.errors(replies).collect()] == [("8", "HTTP status 500")]


def test_refresh_of_every_source(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    bodies = {"datatronic": "<h1>D</h1>", "verkkokauppa": json.dumps([VERKKOKAUPPA_ITEM | {"pid": 1}]), "power": json.dumps([{"productId": 1, "title": "T", "price": 2.0}]), "jimms": "<h1>J</h1>", "multitronic": ld(name="M"), "proshop": ld(name="P"), "gigantti": ld(name="G")}
    for source in bodies:
        engine.track("1", source)
    replies = [(s, "1", 404 if s == "jimms" else 503 if s == "proshop" else 200, None, b) for s, b in bodies.items()]
    got = engine.refresh(product_replies(spark, *replies))
    assert got["updated"] == 5 and {(e["source"], e["error"]) for e in got["errors"].collect()} == {("jimms", "1 no longer listed"), ("proshop", "HTTP status 503")}


def test_sightings_are_numbered_by_arrival(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    rows = listings(spark, [(f"n{i}", float(i + 1), "a") for i in range(3000)]).withColumn("image_url", F.lit(None).cast("string")).repartition(7)
    engine.record(rows)
    seen_ = engine.sightings.orderBy("seq").collect()
    assert len({r.seq for r in seen_}) == 3000 and [r.price_euro for r in seen_] == [float(i + 1) for i in range(3000)]


def test_brand_and_stock_of_repeated_ids(spark):
    data = {"data": [{"id": "5", "attributes": {"name": "Disk"}, "relationships": {"brand": {"data": {"id": "b"}}}}], "included": [{"type": "brands", "id": "b", "attributes": {"name": "X"}}, {"type": "brands", "id": "b", "attributes": {"name": "WD"}}, {"type": "brands", "id": "b", "attributes": {}}]}
    stock = [{"pid": 5, "status": {"schema": "OUTOFSTOCK"}}, {"pid": 5, "status": {"schema": "INSTOCK"}}]
    rows = [("verkkokauppa", "search", "q", json.dumps(data)), ("verkkokauppa", "availability", "5", json.dumps(stock))]
    frame = spark.createDataFrame([(s, k, q, 200, None, {}, b) for s, k, q, b in rows], "source string, kind string, request_key string, status int, final_url string, headers map<string,string>, body string")
    (r,) = parsers.verkkokauppa_search(frame).collect()
    assert (r.brand, r.in_stock) == ("WD", True)


def test_first_stock_icon_counts():
    from offerlens.sources.markup import parse

    card = '<li class="site-productlist-item"><a class="site-product-link" href="/1"></a><h2 product-display-name>N</h2><span class="site-currency-lg">1 €</span><i class="site-icon-stock-out"></i><i class="site-icon-stock-in"></i></li>'
    assert [c["stock_flag"] for c in parsers.proshop_cards(parse(card))] == ["false"]


def test_pages_without_identity_enrich_nothing(spark):
    rows = listings(spark, [("n0", 1.0, "a"), ("n1", 1.0, "a")])
    pages = spark.createDataFrame([("a", "0", None, None, "B"), ("a", "1", None, "s", "B")], "source string, id string, ean string, sku string, brand string")
    got = {r.arrival: (r.brand, r.sku, r.enriched) for r in parsers.enrich(rows, pages).collect()}
    assert got == {0: (None, None, False), 1: ("B", "s", True)}


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    ask = lambda name, **a: json.loads(engine.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}), payloads(spark)))["result"]
    says = lambda name, **a: json.loads(ask(name, **a)["content"][0]["text"])
    found = says("search", query="q", max_price=100)
    assert [r["source"] for r in found["results"]] == ["verkkokauppa", "power", "jimms"] and (found["query"], found["total_hits"], found["filtered_out"], found["errors"]) == ("q", 3, 1, [{"source": "gigantti", "error": "search is not supported"}])
    compared = says("compare", query="q", enrich=True)
    assert (len(compared["groups"]), compared["group_count"], compared["enriched"], compared["filtered_out"]) == (4, 4, 1, 0)
    assert says("get_product", id="31", source="multitronic.fi")["price_euro"] == 124.9 and says("get_product", id="https://www.power.fi/x/p-9/", source="power")["name"] == "Phone"
    assert ask("get_product", id="none", source="jimms")["isError"] and ask("get_product", id="1", source="amazon")["isError"] and ask("set_alert", product_id="31", source="multitronic", below=0)["isError"]
    assert says("set_alert", product_id="9", source="power", below=6) == {"alert_set": True, "product_id": "9", "source": "power", "target_price": 6}
    assert [a["triggered"] for a in says("list_alerts")] == [True] and [t["name"] for t in says("list_tracked")] == ["Phone"]
    says("track", product_id="31", source="multitronic")
    refreshed = says("refresh")
    assert (refreshed["updated"], refreshed["changed"], refreshed["total"], len(refreshed["alerts_triggered"])) == (1, 0, 2, 1) and [e["error"] for e in refreshed["errors"]] == ["9 no longer listed"]
    history = says("price_history", product_id="31", source="multitronic")
    assert history["product"]["name"] == "TV" and [h["price_euro"] for h in history["history"]] == [124.9, 359.9]
    assert says("untrack", product_id="31", source="multitronic")["untracked"] and not says("untrack", product_id="31", source="multitronic")["untracked"]
    assert says("clear_alert", product_id="9", source="power")["alert_cleared"] and says("stats")["products"] == 4 and len(says("sources")) == 7


def test_facade_answers_any_line(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    for line in ("oops", "[]", "1", "null", '{"params":[]}', '{"id":1,"method":"tools/call","params":[1]}', '{"id":1,"method":5}', '{"id":1,"method":"tools/call","params":{"name":[]}}', "[" * 100_000):
        reply = json.loads(engine.handle(line))
        assert reply["error"]["code"] == -32700 and "id" not in reply, line
    assert json.loads(engine.handle('{"id":2,"method":"x"}'))["error"]["code"] == -32601 and engine.handle('{"method":"ping"}') is None
    assert json.loads(engine.handle('{"id":3,"method":"initialize"}'))["result"].keys() == {"protocolVersion", "capabilities", "serverInfo"}
    listed = json.loads(engine.handle('{"id":4,"method":"tools/list"}'))["result"]["tools"]
    assert len(listed) == 13 and all(t["description"] and t["inputSchema"]["type"] == "object" for t in listed)
    assert {t["name"]: t["inputSchema"].get("required") for t in listed}["get_product"] == ["id", "source"]
    for name, arguments in [("search", {}), ("search", {"query": " "}), ("compare", None), ("nothing", {}), ("", {}), ("set_alert", {"product_id": "1", "source": "power", "below": "x"}), ("set_alert", {"product_id": "1", "source": "power", "below": True}), ("track", {"product_id": 7, "source": "power"}), ("get_product", {"id": "http://x", "source": "jimms"})]:
        reply = json.loads(engine.handle(json.dumps({"id": 5, "method": "tools/call", "params": {"name": name, "arguments": arguments}})))
        assert reply["result"]["isError"] and reply["result"]["content"][0]["text"], name
    odd = json.loads(engine.handle(json.dumps({"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "q", "limit": "x", "min_price": "cheap"}}})))
    assert not odd["result"]["isError"] and json.loads(odd["result"]["content"][0]["text"])["results"] == []


def test_search_parses_once(spark, tmp_path, monkeypatch):
    """Record, rows and counters come from one pass over the replies; a refresh folds its own batch only."""
    from offerlens.operators import ledger

    engine, calls = Engine(spark, f"file://{tmp_path}"), []
    parse = parsers.search_listings
    monkeypatch.setattr(parsers, "search_listings", lambda *a: calls.append(a) or parse(*a))
    seen_ = spark.sparkContext.accumulator(0)
    read = parsers._read
    monkeypatch.setattr(parsers, "_read", lambda replies, rows_of, with_url=False: read(replies, lambda *a: (seen_.add(1), rows_of(*a))[1], with_url))
    found = engine.search(payloads(spark))
    assert found.rows.count() == 4 and found.counts == {"total_hits": 4, "filtered_out": 0} and engine.sightings.count() == 4
    assert len(calls) == 1 and seen_.value == 1  # one HTML reply
    folded, fold = [], ledger.Ledger.folding
    monkeypatch.setattr(ledger.Ledger, "folding", lambda self, rows: folded.append(sorted(r.seq for r in rows.collect())) or fold(self, rows))
    engine.track("31", "multitronic")
    assert engine.refresh(payloads(spark))["changed"] == 1 and [len(f) for f in folded] == [1]


def test_a_folder_of_the_first_layout_is_read_on(spark, tmp_path):
    """Sightings without batches and without newer columns: read, folded once, and written on."""
    old = spark.createDataFrame([("1", "power", START, 1, "N", "u", None, 5.0, True, "e", "b"), ("1", "power", START, 2, "N", "u", None, 5.0, True, None, None), ("1", "power", START, 3, "N", "u", None, 6.0, True, None, None)], "product_id string, source string, recorded_at timestamp, seq long, name string, url string, image_url string, price_euro double, in_stock boolean, ean string, brand string")
    old.write.partitionBy("source").parquet(f"{tmp_path}/sightings")
    engine = Engine(spark, f"file://{tmp_path}")
    assert [(r.ean, r.sku, r.brand) for r in engine.products.collect()] == [("e", None, "b")] and engine.history.count() == 2
    rows = listings(spark, [("N", 6.0, "power")]).withColumns({"id": F.lit("1"), "sku": F.lit("s"), "image_url": F.lit(None).cast("string")})
    assert engine.record(rows).count() == 0 and engine.record(rows.withColumn("price_euro", F.lit(7.0))).count() == 1
    assert [(r.ean, r.sku) for r in engine.products.collect()] == [("e", "s")] and engine.sightings.count() == 5 and engine.history.count() == 3


def test_a_stream_is_recorded(spark, tmp_path):
    from offerlens.api import SIGHTINGS

    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.record(listings(spark, [("N", 5.0, "power")]).withColumn("image_url", F.lit(None).cast("string")))
    for n, price in enumerate([5.0, 8.0, 8.0]):
        spark.createDataFrame([("0", "power", datetime(2100, 1, 1), 2**62 + n, "N", "u", None, price, True, None, None, None)], SIGHTINGS).write.mode("append").parquet(f"{tmp_path}/in")
        engine.follow(spark.readStream.schema(SIGHTINGS).parquet(f"{tmp_path}/in"), f"{tmp_path}/log").awaitTermination()
    assert engine.sightings.count() == 4 and sorted(r.price_euro for r in engine.history.collect()) == [5.0, 8.0]


def test_enrichment(spark):
    rows = listings(spark, [(f"n{i}", 1.0, "a", E1 if i == 0 else None) for i in range(5)])
    pages = spark.createDataFrame([("a", "1", "e", None, "b"), ("a", "4", "e", "s", "b")], "source string, id string, ean string, sku string, brand string")
    got = {r.arrival: r for r in parsers.enrich(rows, pages, budget=3).collect()}
    assert got[1].ean == "e" and got[1].enriched and got[4].ean is None and not got[4].enriched and got[0].ean == E1


@pytest.mark.parametrize("name", ["latest_price", "match_groups", "pair_scores"])
def test_catalogue(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0 and entry.entry(spark).count() > 0
