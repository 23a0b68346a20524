"""The data source of captured replies, and which replies give listings or errors."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from offerlens.sources import captures, parsers
from offerlens.schemas import PAYLOADS


def line(key, **more):
    return json.dumps({"request_key": key, "status": 200, "headers": {"a": "b"}, "body": "x" * 50} | more) + "\n"


@pytest.fixture
def folder(tmp_path):
    """Plain, compressed, nested, hidden, empty and broken files of two sources and kinds."""
    for source, kind, name, data in [
        ("power", "search", "a.jsonl", "".join(line(f"p{n}") for n in range(300)).encode()), ("power", "search", "day=1/b.jsonl.gz", gzip.compress(b"".join(line(f"z{n}").encode() for n in range(50)))),
        ("power", "product", "c.jsonl", line("q1").encode() + b"{no json\n[1]\n\n" + line("q2", status="200").encode() + line("q3", body=None, headers=None).encode()[:-1]), ("jimms", "search", "d.jsonl", b""),
        ("jimms", "search", "e.jsonl.gz", gzip.compress(line("j1").encode() * 400)[:60]), ("jimms", "search", "_hidden", b"oops"), ("jimms", "product", "f.jsonl", line("k1").encode()), ("jimms", "product", "g.jsonl", b"\xff\xfe\n"),
    ]:
        path = tmp_path / f"source={source}" / f"kind={kind}" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def keys(df):
    return sorted(r.request_key for r in df.filter("error IS NULL").collect())


POWER = sorted([f"p{n}" for n in range(300)] + [f"z{n}" for n in range(50)])


@pytest.mark.parametrize("split", [64 << 20, 5000, 97])
def test_every_line_is_read_once(spark, folder, split):
    df = captures.read(spark, folder, splitBytes=split)
    assert keys(df.filter("source = 'power' AND kind = 'search'")) == POWER
    if split == 5000:
        assert df.rdd.getNumPartitions() > 6
    rows = {r.request_key: r for r in df.filter("kind = 'product'").collect()}
    assert (rows["q3"].body, rows["q3"].headers, rows["q1"].headers, rows["k1"].status) == (None, None, {"a": "b"}, 200)


def test_broken_lines_and_files_are_rows(spark, folder):
    errors = captures.read(spark, folder).filter("error IS NOT NULL").collect()
    assert sorted((r.source, os.path.basename(r.capture_file), r.error.split(":")[0]) for r in errors) == [
        ("jimms", "e.jsonl.gz", "broken file"), ("jimms", "g.jsonl", "broken line"), ("power", "c.jsonl", "broken line"), ("power", "c.jsonl", "broken line"), ("power", "c.jsonl", "broken line")
    ]
    said = parsers.errors(captures.Folder(spark, folder)).filter("error LIKE 'broken%'")
    assert said.count() == 5


def test_options_and_filters_prune_partitions(spark, folder):
    whole = captures.read(spark, folder).rdd.getNumPartitions()
    some = captures.Folder(spark, folder).only(["power"], ["search"])
    assert some.rdd.getNumPartitions() < whole and keys(some) == POWER
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = captures.read(spark, folder, pushdown="true").filter("source = 'power' AND kind IN ('search', 'category') AND request_key = 'p7' AND status = 200")
        plan = spark._jvm.PythonSQLUtils.explainString(pushed._jdf.queryExecution(), "formatted")
        assert "EqualTo(source,power)" in plan and "EqualTo(request_key,p7)" in plan
        assert pushed.rdd.getNumPartitions() < whole and [r.request_key for r in pushed.collect()] == ["p7"]
        assert captures.read(spark, folder, pushdown="true").filter("source = 'power' AND source = 'jimms'").count() == 0
        assert captures.read(spark, folder, pushdown="true").filter("request_key IS NULL").count() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_captures(spark, tmp_path):
    assert captures.read(spark, str(tmp_path / "none")).collect() == []
    assert captures.read(spark, f"file:{tmp_path}", source="nobody").collect() == []


def test_stream_of_captures(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def run():
        stream = captures.read_stream(spark, folder, settleSeconds=0, filesPerBatch=2).filter("error IS NULL").select("request_key")
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.request_key for r in spark.read.parquet(f"{at}/out").collect())

    first = run()
    assert first == sorted([*POWER, "q1", "q3", "k1"]) and len(os.listdir(at / "log" / "commits")) > 3
    with open(f"{folder}/source=jimms/kind=product/new.jsonl", "w") as f:
        f.write(line("late"))
    assert run() == sorted([*first, "late"])


def payload_rows(spark, *rows):
    return spark.createDataFrame([(s, k, q, c, None, h, b) for s, k, q, c, h, b in rows], PAYLOADS)


CARDS = {
    "datatronic": '<article class="product-miniature" data-id-product="1"><h3 class="product-title"><a href="/p/1">Name</a></h3><span class="price">9,50 €</span></article>',
    "multitronic": '<div class="item_wrapper" data-code="K"><a class="pTitle" href="/fi/products/1/n">Name</a><div class="productDataEntry" data-price="9.5"></div></div>',
    "proshop": '<li class="site-productlist-item"><a class="site-product-link" href="/n/1"></a><h2 product-display-name>Name</h2><span class="site-currency-lg">9,50 €</span><input name="productId" value="1"></li>',
    "verkkokauppa": '{"data":[{"id":"1","attributes":{"name":"Name","price":{"current":9.5}}}]}', "power": '{"products":[{"productId":1,"title":"Name","price":9.5}]}', "jimms": '{"Products":[{"ProductID":1,"Name":"Name","PriceTax":9.5}]}',
}


def test_a_reply_has_listings_or_an_error(spark):
    """What arrived is listed; a failed status or a challenge is an error only, and leaves the other sources alone."""
    for status, headers, error, again in [(500, {}, "HTTP status 500", True), (403, {}, "HTTP status 403", False), (429, {"x-vercel-challenge-token": "t"}, "blocked by a bot challenge", True), (200, {"X-Vercel-Mitigated": "Challenge"}, "blocked by a bot challenge", False)]:
        for bad in CARDS:
            replies = payload_rows(spark, *((s, "search", "q", status if s == bad else 200, headers if s == bad else {}, b) for s, b in CARDS.items()))
            if bad in ("power", "multitronic"):  # one of each reader; the others share their code
                assert {r.source: (r.id, r.price_euro) for r in parsers.search_listings(replies).collect()} == {s: ("1", 9.5) for s in CARDS if s != bad}
            assert [tuple(r) for r in parsers.errors(replies).collect()] == [("q", bad, error, again)]


def test_json_of_another_shape_is_an_error(spark):
    bodies = {
        "power": ['{"products":"oops"}', "[]", '{"products":[{"productId":"x"}]}', "7"], "jimms": ['{"Products":{"a":1}}', "[1]", '{"Products":[{"ProductID":1,"PriceTax":"cheap"}]}'],
        "verkkokauppa": ['{"data":"oops"}', '{"data":[{"attributes":{"name":"no id"}}]}', '{"data":[{"id":"1"}]}', '{"included":[{"id":"b"}]}', "null"],
    }
    replies = payload_rows(spark, *((s, "search", f"{n}", 200, {}, b) for s, some in bodies.items() for n, b in enumerate(some)))
    assert parsers.search_listings(replies).collect() == []
    assert {(r.query_id, r.source, r.error) for r in parsers.errors(replies).collect()} == {(f"{n}", s, "reply has another shape") for s, some in bodies.items() for n in range(len(some))}
    fine = payload_rows(spark, ("power", "search", "a", 200, {}, "{}"), ("jimms", "search", "b", 200, {}, '{"more":1}'), ("verkkokauppa", "search", "c", 200, {}, '{"data":[]}'), ("power", "search", "d", 200, {}, "<html>"))
    assert [(r.query_id, r.error) for r in parsers.errors(fine).collect()] == [("d", "reply is no JSON")]


def test_not_found_by_source(spark):
    """410 is an answer of every retailer but one."""
    rows = [(s, "product", s, c, {}, "") for s, c in [("gigantti", 404), ("proshop", 410), ("power", 404)]] + [("gigantti", "product", "gone", 410, {}, "")]
    assert [(r.query_id, r.error) for r in parsers.errors(payload_rows(spark, *rows)).collect()] == [("gone", "HTTP status 410")]


def test_stock_replies_never_fail(spark):
    rows = [("verkkokauppa", "search", "q", 200, {}, CARDS["verkkokauppa"]), ("verkkokauppa", "availability", "1", 500, {}, '[{"pid":1,"status":{"schema":"InStock"}}]'), ("verkkokauppa", "availability", "1", 200, {}, "oops")]
    replies = payload_rows(spark, *rows)
    assert [r.in_stock for r in parsers.search_listings(replies).collect()] == [None] and parsers.errors(replies).collect() == []


def test_cards_of_datatronic_and_proshop(spark):
    """Stock icons, fallbacks of images and ids, and cards that lack something."""
    proshop = (
        '<ul><li class="site-productlist-item"><a class="site-product-link" href="/Disk/900"></a><h2 product-display-name>Disk &amp; more</h2><span class="site-currency-lg">1.299,00 €</span><i class="site-icon-stock-comming"></i><span class="site-icon-stock-in"></span><img data-src="//cdn/p.jpg"></li>'
        '<li class="site-productlist-item"><a class="site-product-link" href="/x/1"></a><h2 product-display-name></h2><span class="site-currency-lg">1</span></li><li class="site-productlist-item"><h2 product-display-name>No link</h2></li></ul>'
    )
    datatronic = (
        '<div class="js-product-miniature" data-id-product="77"><div class="product-description"><a href="https://www.datatronic.fi/koti/77-x.html"><img data-full-size-image-url="/f.jpg">TV 65</a></div><div class="product-price-and-shipping"><span class="price">899,-</span></div></div>'
        '<article data-id-product="78"><h3 class="h3 product-title"><a href="/78">ab</a></h3><span class="price">1</span></article>'
    )
    replies = payload_rows(spark, ("proshop", "search", "q", 200, {}, proshop), ("datatronic", "category", "q", 200, {}, datatronic))
    got = {r.source: (r.id, r.name, r.price_euro, r.in_stock, r.image_url) for r in parsers.html_search(replies).collect()}
    assert got == {"proshop": ("900", "Disk & more", 1299.0, False, "https://cdn/p.jpg"), "datatronic": ("77", "TV 65", 899.0, None, "https://www.datatronic.fi/f.jpg")}


def test_fields_of_power_and_jimms(spark):
    power = {"products": [{"productId": 1, "title": "A", "manufacturerName": " ", "productManufactorIdentity": "", "productImage": {"variants": [{"filename": "f"}]}}, {"productId": 2, "title": "B", "productImage": {"basePath": "/m/", "variants": [{"filename": "f"}]}}]}
    jimms = {"Products": [{"ProductID": 1, "Name": "acme Board", "VendorName": " Acme ", "Code": " ", "Uri": " /Product/1 ", "ImageBaseSrc": "//i/", "ImageID": 4, "ItemAvailability": 4}, {"ProductID": 2, "Name": "Disk", "VendorName": "WD", "Uri": " ", "ImageBaseSrc": " ", "ImageID": 4, "ItemAvailability": 1}]}
    replies = payload_rows(spark, ("power", "search", "q", 200, {}, json.dumps(power)), ("jimms", "search", "q", 200, {}, json.dumps(jimms)))
    p = {r.id: (r.sku, r.brand, r.image_url) for r in parsers.power_search(replies).collect()}
    assert p == {"1": (None, None, None), "2": (None, None, "https://media.power-cdn.net/m/f")}
    j = {r.id: (r.name, r.sku, r.brand, r.url, r.image_url, r.in_stock) for r in parsers.jimms_search(replies).collect()}
    assert j == {"1": ("acme Board", None, "Acme", "https://www.jimms.fi/fi/Product/1", "https://i/4-ig400gg.jpg", False), "2": ("WD Disk", None, "WD", "https://www.jimms.fi/fi/Product/Show/2", None, True)}


def test_write_and_read_back(spark, tmp_path):
    rows = payload_rows(spark, ("power", "search", "a b", 200, {"h": "v"}, "{}"), ("a/b", "search", "q", None, None, None))
    captures.write(rows, f"file://{tmp_path}/c")
    got = captures.read(spark, f"file://{tmp_path}/c")
    assert sorted((r.source, r.request_key, r.status, r.headers, r.body) for r in got.filter(F.col("error").isNull()).collect()) == [("a/b", "q", None, None, None), ("power", "a b", 200, {"h": "v"}, "{}")]


def test_pages_of_listings_hold_so_many(spark):
    """A limit above a source's page size gives a page; others have theirs."""
    card = CARDS["multitronic"]
    replies = payload_rows(spark, ("multitronic", "search", "q", 200, {}, "".join(card.replace("/1/n", f"/{n}/n") for n in range(40))), ("power", "search", "q", 200, {}, json.dumps({"products": [{"productId": n, "title": "T"} for n in range(120)]})))
    count = lambda limit: {r.source: r["count"] for r in parsers.search_listings(replies, limit).groupBy("source").count().collect()}
    assert count(200) == {"multitronic": 24, "power": 100} and count(30) == {"multitronic": 24, "power": 30} and count(3) == {"multitronic": 3, "power": 3}
