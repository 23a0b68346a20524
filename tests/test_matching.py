"""Candidate pairs against all pairs, and grouping against a plain model that follows the order of arrival."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from offerlens.operators import matching as M
from offerlens.operators.identity import signature

LISTING = "query_id string, arrival long, name string, ean string, sku string, brand string"
EANS = ["0730143314350", "5032037150354", None, None, None, None]


@pytest.fixture(scope="module")
def signed(spark):
    """Listings of all kinds: with and without models, sizes, EANs and SKUs, two queries, long and empty names."""
    draw = random.Random(8)
    parts = [["Samsung", "WD", "Kingston", "kaapeli"], ["990", "980", "SN850X", "", "musta levy"], ["PRO", "EVO", "", ""], ["1TB", "2 Tt", "", "1000GB"], ['55"', "", "", "65 tuuman"], ["NVMe", "SSD", "nopea hieno uusi", "jäähdytyssiili"]]
    rows = [(f"q{i % 2}", i, " ".join(draw.choice(p) for p in parts), draw.choice(EANS), draw.choice(["ab-123", "zz999", None, None, None]), draw.choice(["WD", "LG", None])) for i in range(120)]
    rows += [("q0", 200, "", None, None, None), ("q0", 201, None, None, None, None), ("q1", 202, "the and", None, None, "WD"), ("q1", 203, "x", None, None, "WD")]
    return signature(spark.createDataFrame(rows, LISTING)).cache()


@pytest.fixture(scope="module")
def all_pairs(signed):
    side = lambda n: signed.select("query_id", F.col("arrival").alias(n), F.struct(*M.SIGNATURE).alias(f"s{n}"))
    judged = side("a").join(side("b"), "query_id").filter("a < b").withColumn("v", M.verdict("sa", "sb")).filter("v IS NOT NULL")
    return {(r.query_id, r.a, r.b): (r.v.score, r.v.basis) for r in judged.collect()}


@pytest.mark.parametrize("threshold", [0.01, 0.1, 0.11, 0.2, 0.25, 0.33, 0.4, 0.41, 0.55, 0.9])
def test_no_pair_is_lost(signed, all_pairs, threshold):
    found = M.scored_pairs(signed, threshold, hot=7 if threshold in (0.25, 0.55) else M.HOT).collect()
    got = {(r.query_id, r.a, r.b): (r.score, r.basis) for r in found}
    assert len(got) == len(found)  # each pair once
    want = {k: v for k, v in all_pairs.items() if v[0] >= threshold}
    assert {k: v for k, v in got.items() if v[0] >= threshold} == want and want and got.items() <= all_pairs.items()


def test_a_token_in_all_names_is_no_hot_key(spark):
    """One model token everywhere: only what agrees in qualifiers, size and capacity meets."""
    qualifiers, sizes = ["", "pro", "evo", "ti", "super", "max", "mini", "ultra"], [f'{n}"' for n in range(20, 70, 5)]
    rows = [("q", i, f"Levy X900 {qualifiers[i % 8]} {sizes[i // 8 % 10]} {i // 80 % 10 + 1}TB", None, None, None) for i in range(1600)]
    listings = signature(spark.createDataFrame(rows, LISTING))
    met = M.candidates(listings, hot=50).count()
    assert met == 800 and M.scored_pairs(listings, hot=50).count() == met < 1600 * 1599 // 2 / 1000


def test_name_keys_are_a_prefix(spark):
    """At 0.33 four fifths of the smaller name must be shared: common words are no keys, rare ones are."""
    rows = [("q", i, f"hyva uusi levy malli nimi{'abcdefghij'[i // 2 % 10]}{'abcdefghij'[i // 20]}", None, None, "WD") for i in range(200)]
    listings = signature(spark.createDataFrame(rows, LISTING))
    prefix = M._with_prefix(listings, 0.33).select(F.size("prefix").alias("n"), F.size("name_tokens").alias("m")).distinct().collect()
    assert [(r.n, r.m) for r in prefix] == [(2, 5)]
    assert M.scored_pairs(listings, 0.33).filter("score >= 0.33").count() == 200 * 199 // 2  # all share four of five
    assert M.scored_pairs(listings, 0.39).filter("score >= 0.39").count() == 100 and M.candidates(listings, 0.39).count() == 100


def total(scores):
    """Added one by one, as the rule does; ``sum`` compensates for rounding."""
    out = 0.0
    for s in scores:
        out += s
    return out


def plain_clusters(n, links):
    """(members, confidence, basis) by the rule: best mean among clusters that all links lead to, then first pairs merged."""
    of = lambda i, j: links.get((min(i, j), max(i, j)))
    groups = []
    for x in range(n):
        best = None
        for g in groups:
            some = [of(x, m) for m in g[0]]
            if all(some) and (best is None or total(s for s, _ in some) / len(some) > best[0]):
                best = (total(s for s, _ in some) / len(some), min(b for _, b in some), g)
        if best is None:
            groups.append([[x], 1.0, M.NAME])
        else:
            g = best[2]
            g[0].append(x)
            g[1], g[2] = min(g[1], best[0]), min(g[2], best[1])
    again = True
    while again:
        again = False
        for i, j in combinations(range(len(groups)), 2):
            some = [of(a, b) for a in groups[i][0] for b in groups[j][0]]
            if all(some):
                g, h = groups[i], groups.pop(j)
                g[0] += h[0]
                g[1], g[2] = min(g[1], h[1], *(s for s, _ in some)), min(g[2], h[2], *(b for _, b in some))
                again = True
                break
    return groups


def test_grouping_of_random_links(spark):
    """Many small queries at once, of all densities. The model's merging finds nothing, as the module's proof says."""
    draw, rows, want = random.Random(3), [], {}
    for q in range(150):
        n, p = draw.randrange(2, 14), draw.choice([0.3, 0.6, 0.85, 0.95])
        links = {(a, b): (draw.choice([0.55, 0.6, 0.7, 0.97, 1.0]), draw.randrange(4)) for a, b in combinations(range(n), 2) if draw.random() < p}
        rows += [(f"q{q}", a, b, s, k) for (a, b), (s, k) in links.items()]
        linked = {x for pair in links for x in pair}
        want |= {(f"q{q}", m): (g[0][0], i, g[1], g[2]) for g in plain_clusters(n, links) for i, m in enumerate(g[0]) if m in linked}
    pairs = spark.createDataFrame(rows, "query_id string, a long, b long, score double, basis int")
    got = M.assigned(pairs.withColumn("unit", F.lit(0).cast("long"))).collect()
    assert {(r.query_id, r.arrival): (r.head, r.place, pytest.approx(r.confidence), r.basis) for r in got} == want and len(got) == len(want)


def test_a_component_of_ten_thousand(spark):
    """One query, one component: families of up to 12 that are joined by single links; with and without components."""
    draw, links = random.Random(1), {}
    order = list(range(10_000))
    draw.shuffle(order)
    for at in range(0, 10_000, 10):
        family = order[at : at + 12]
        for a, b in combinations(family, 2):
            if draw.random() < 0.93:
                links[(min(a, b), max(a, b))] = (draw.choice([0.6, 0.7, 0.8]), 2)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    head, members = {}, {}  # the plain model, by neighbours only
    for x in range(10_000):
        best = None
        for h in sorted({head[y] for y in near[x] if y < x}):
            if all(m in near[x] for m in members[h]):
                mean = total(links[(m, x)][0] for m in members[h]) / len(members[h])
                best = (mean, h) if best is None or mean > best[0] else best
        head[x] = x if best is None else best[1]
        members.setdefault(head[x], []).append(x)
    for i in sorted(members):
        for j in sorted({head[y] for m in members.get(i, []) for y in near[m]}):
            if j > i and i in members and j in members and all(b in near[a] for a in members[i] for b in members[j]):
                gone = members.pop(j)
                members[i] += gone
                head |= dict.fromkeys(gone, i)
    pairs = M._written(spark.createDataFrame([("q", a, b, s, k) for (a, b), (s, k) in links.items()], "query_id string, a long, b long, score double, basis int"), "scored")
    got = M.assigned(pairs.withColumn("unit", F.lit(0).cast("long"))).collect()
    assert {r.arrival: (r.head, r.place) for r in got} == {m: (h, i) for h, some in members.items() for i, m in enumerate(some)}


def test_components_change_nothing(spark, signed):
    key = lambda d: sorted((r.query_id, r.arrival, r.head, r.place, r.confidence, r.basis) for r in d.collect())
    assert key(M.clusters(signed, 0.3)) == key(M.clusters(signed, 0.3, links_at_once=0))


@pytest.fixture(scope="module")
def sharing(signed):
    """Pairs of a query that share an EAN, a SKU or a model token, by plain loops."""
    rows = signed.select("query_id", "arrival", "ean_key", "sku_key", "model_tokens").collect()
    same = lambda x, y: x is not None and x == y
    met = lambda x, y: x.query_id == y.query_id and (same(x.ean_key, y.ean_key) or same(x.sku_key, y.sku_key) or set(x.model_tokens) & set(y.model_tokens))
    return sorted((x.query_id, x.arrival, y.arrival) for x in rows for y in rows if x.arrival < y.arrival and met(x, y))


@pytest.mark.parametrize("hot, at_once", [(M.HOT, M.AT_ONCE), (M.HOT, 0), (7, 0), (7, 61)])
def test_blocking_forbids_nothing(signed, sharing, all_pairs, hot, at_once):
    """All that share a key, those that the score rules out too; each once. The two queries have 62 listings each."""
    assert sorted(tuple(r) for r in M.blocked(signed, hot, at_once).collect()) == sharing
    assert len(set(sharing)) == len(sharing) and not set(sharing) <= set(all_pairs)


@pytest.mark.parametrize("threshold", [0.01, 0.1, 0.11, 0.25, 0.4, 0.41, 0.55])
def test_no_pair_is_lost_by_keys(signed, all_pairs, threshold):
    """Queries too large to be held side by side give the same pairs and scores."""
    for hot in (7, M.HOT):
        found = M.scored_pairs(signed, threshold, hot, at_once=0).collect()
        got = {(r.query_id, r.a, r.b): (r.score, r.basis) for r in found}
        assert len(got) == len(found) and got.items() <= all_pairs.items()
        assert {k: v for k, v in got.items() if v[0] >= threshold} == {k: v for k, v in all_pairs.items() if v[0] >= threshold}


def test_both_ways_meet_the_same(signed):
    """Above 0.40 keys and conditions say the same of every pair."""
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(M.candidates(signed)) == key(M.candidates(signed, at_once=0)) == key(M.candidates(signed, hot=7, at_once=61))


def plan_of(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_a_listing_is_not_shuffled_by_key(spark, signed):
    """Small queries have no rows by key; of large ones the rows by key carry no names."""
    assert "Generate explode" not in plan_of(spark, M.scored_pairs(signed))
    keyed = [line for line in plan_of(spark, M._pairs_by_keys(signed, M.THRESHOLD, M.HOT)).splitlines() if "Generate explode" in line or "AS x#" in line]
    assert keyed and not any("name_tokens, name_tokens" in line for line in keyed)
