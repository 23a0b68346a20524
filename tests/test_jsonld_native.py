"""The VARIANT reader of JSON-LD against the tree reader."""

import json
import random

from pyspark.sql import functions as F

from offerlens.sources import jsonld
from offerlens.sources import jsonld_native as N


def script(value, tag='type="application/ld+json"'):
    return f"<script {tag}>{value if isinstance(value, str) else json.dumps(value)}</script>"


def both(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page long, html string")
    got = {r.page: {k: v for k, v in r.asDict().items() if k != "page"} for r in N.products(df, "page", "html").collect()}
    want = {i: found for i, p in enumerate(pages) if (found := jsonld.find(p or "")) is not None}
    assert got == want
    return want


def test_shapes(spark):
    product = {"@type": "Product", "name": "N"}
    pages = [
        None, "", "<p>none</p>", script("oops") + script(product), script([]), script({"@graph": {"@graph": [[], [product]]}}), script({"@type": "Thing", "@graph": [{"@type": 5}, product | {"name": " A "}]}),
        script(product | {"offers": [{"price": "100"}, {"price": "124,90", "eligibleCustomerType": {"@id": "http://x/PublicUser"}}]}), script(product | {"offers": [{"price": 1}, {"price": 2, "priceSpecification": {"valueAddedTaxIncluded": True}}]}),
        script(product | {"offers": {"offers": {"offers": [{"price": 3.25, "url": "/u"}]}, "price": 9}}), script(product | {"offers": {"offers": [], "price": 9}}), script(product | {"offers": {"offers": {}, "price": 9}}), script(product | {"offers": "no"}),
        script(product | {"gtin": "", "gtin12": " 12 ", "gtin8": "8", "sku": True, "mpn": 7.5, "brand": [" ", {"name": "B"}], "image": [{"contentUrl": "c"}, "d"], "url": "/p"}), script(product, "type='application/ld+json' id=a"), script(product, "TYPE = application/ld+json"),
        script(product, 'type="text/javascript"'), script(product, 'data-type="application/json" type="application/ld+json"') + script(product | {"name": "second"}), script({"@type": ["product"], "name": {"a": 1}, "brand": 5, "image": True}), script("null") + script("5") + script('"Product"'),
    ]
    assert len(both(spark, pages)) == 14


def test_random_documents(spark):
    draw = random.Random(2)

    def value(depth):
        kind = draw.randrange(9 if depth < 4 else 5)
        if kind < 5:
            return [None, True, draw.randrange(100), draw.choice(["", " x ", "Product", "public"]), 1.5][kind]
        if kind == 5:
            return [value(depth + 1) for _ in range(draw.randrange(3))]
        keys = ["@type", "@graph", "name", "sku", "gtin", "gtin13", "brand", "image", "url"]
        return {k: draw.choice(["Product", ["Thing", "product"], "Thing"]) if k == "@type" else value(depth + 1) for k in draw.sample(keys, draw.randrange(5))} | ({"offers": offers(0)} if draw.random() < 0.5 else {})

    def offers(depth):
        one = {"price": draw.choice([1, 2.5, "3", None]), "url": draw.choice(["/o", None])} | ({"eligibleCustomerType": draw.choice(["PublicUser", "Business"])} if draw.random() < 0.3 else {}) | ({"offers": offers(depth + 1)} if depth < 2 and draw.random() < 0.4 else {})
        return [one, offers(3)] if draw.random() < 0.4 and depth < 3 else one

    flat = lambda x: isinstance(x, list) and any(isinstance(y, list) for y in x)

    def nested(x):
        """Lists in lists in a named field: the tree reader looks into them, this one doesn't."""
        return isinstance(x, dict) and any(flat(x.get(k)) or nested(x.get(k)) for k in x if k != "@graph") or isinstance(x, list) and any(map(nested, x)) or isinstance(x, dict) and nested(x.get("@graph"))

    documents = [d for d in (value(0) for _ in range(1500)) if not nested(d)]
    assert len(both(spark, [script(d) for d in documents])) > 60


def test_no_python_in_the_plan(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(N.products(spark.createDataFrame([(1, script({"@type": "Product"}))], "page long, html string").withColumn("html", F.col("html")), "page", "html")._jdf.queryExecution(), "formatted")
    assert not any(x in plan for x in ("EvalPython", "InArrow", "InPandas"))


def test_a_level_is_read_once(spark):
    """Levels below one another are written: the plan neither takes scripts by the pattern nor parses a second time."""
    deep = script({"@graph": [{"@graph": [[{"@type": "Product", "name": "N"}]]}]})
    found = N.nodes(spark.createDataFrame([(1, deep)], "page long, html string"), "page", "html")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Generate" not in plan and "try_parse_json" not in plan.lower() and [r.page for r in found.collect()] == [1]
