"""The queries again, as SQL for DuckDB."""

from __future__ import annotations

from ..functions import scalars as S
from ..functions import text as T
from ..sources.registry import ROWS
from .tables import common


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_OFFERS, _TITLES, _SIGHTINGS, _ACTIONS, _PRICES = (common(n) for n in ("offers", "titles", "sightings", "actions", "prices"))
_LATEST = """, latest AS (SELECT product_id, source, arg_max_null(price_euro, row(recorded_at, seq)) AS price_euro, arg_max_null(in_stock, row(recorded_at, seq)) AS in_stock, max(recorded_at) AS recorded_at
FROM offers GROUP BY 1, 2)"""
_TITLES_EAN = _TITLES + """, listings AS (SELECT * EXCLUDE (ean0), CASE WHEN length(ean0) = 12 THEN concat(ean0, (10 - list_sum(list_transform(range(1, 13), lambda i: substr(ean0, i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))::INT % 10) % 10) ELSE ean0 END AS ean FROM titles)"""
_FOLD = f"replace(translate(lower({{}}), '{T.FOLD_FROM}', '{T.FOLD_TO}'), 'ß', 'ss')"
_CANON = (
    "CASE regexp_extract({t}, '^[0-9]+([a-z][0-9a-z]*)$', 1) "
    + " ".join(f"WHEN '{u}' THEN concat('cap:', round(regexp_extract({{t}}, '^([0-9]+)', 1)::DOUBLE * {f[:-1]}::DOUBLE)::BIGINT, 'gb')" for u, f in T.STORAGE.items())
    + " "
    + " ".join(f"WHEN '{u}' THEN concat(regexp_extract({{t}}, '^([0-9]+)', 1)::BIGINT, '{c}')" for u, c in T.MEASURES.items())
    + " END"
)
#: An inch mark after a digit becomes the word; a second pass covers marks in a row.
_EXPAND = """regexp_replace(regexp_replace({}, '([0-9])["”″]', '\\1inch', 'g'), 'inch["”″]', 'inchinch', 'g')"""
_GTIN = """CASE WHEN gb IS NOT NULL AND (10 - list_sum(list_transform(range(1, length(gb)), lambda i: substr(gb, i, 1)::INT * CASE WHEN (length(gb) - i) % 2 = 1 THEN 3 ELSE 1 END))::INT % 10) % 10 = right(gb, 1)::INT
    AND NOT (left(repeat(left(gb, 1), 13), length(gb) - 1) = left(gb, length(gb) - 1) OR left(repeat(left(gb, 2), 13), length(gb) - 1) = left(gb, length(gb) - 1) OR left(repeat(left(gb, 3), 13), length(gb) - 1) = left(gb, length(gb) - 1)) THEN gb END"""
_SIGNED = (
    _TITLES_EAN
    + f""", expanded AS (SELECT *, {_EXPAND.format(_FOLD.format("name"))} AS e FROM listings),
tokened AS (SELECT *, list_filter(string_split(regexp_replace(trim(regexp_replace(e, '[^0-9a-z]+', ' ', 'g')), '\\b([0-9]+) ({T.UNITS})\\b', '\\1\\2', 'g'), ' '), lambda t: t <> '') AS toks FROM expanded),
sets AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(toks, lambda t: {_CANON.format(t="t")}), lambda s: s IS NOT NULL))) AS spec_tokens,
  list_sort(list_distinct(list_filter(toks, lambda t: regexp_matches(t, '[0-9]') AND (regexp_matches(t, '[a-z]') OR length(t) >= 3) AND t NOT IN ({_in(T.BUS_OR_FORM)}) AND NOT regexp_matches(t, '^[0-9]+({T.UNITS})$')))) AS model_tokens,
  list_sort(list_distinct(list_transform(list_filter(toks, lambda t: length(t) > 1 AND t NOT IN ({_in(T.STOP_WORDS)})), lambda t: coalesce({_CANON.format(t="t")}, t)))) AS name_tokens,
  list_sort(list_distinct(list_concat(list_filter(toks, lambda t: t IN ({_in(T.LINE_QUALIFIERS)})), CASE WHEN regexp_matches(e, '{T.HEATSINK}') AND NOT regexp_matches(e, 'ilman |without ') THEN ['heatsink'] ELSE [] END))) AS qualifiers FROM tokened),
gtins AS (SELECT *, regexp_replace(ean, '[^0-9]', '', 'g') AS gd FROM sets),
bodies AS (SELECT *, CASE length(gd) WHEN 8 THEN gd WHEN 12 THEN concat('0', gd) WHEN 13 THEN gd WHEN 14 THEN substr(gd, 2) END AS gb FROM gtins),
signed AS (SELECT *, {_GTIN} AS ean_key,
  CASE WHEN length(regexp_replace({_FOLD.format("sku")}, '[^a-z0-9]', '', 'g')) >= 4 THEN regexp_replace({_FOLD.format("sku")}, '[^a-z0-9]', '', 'g') END AS sku_key,
  coalesce(nullif(trim(regexp_replace({_FOLD.format("brand")}, '[^a-z0-9 ]', '', 'g')), ''), CASE WHEN regexp_matches(toks[1], '^[a-z][a-z][a-z]+$') THEN toks[1] END) AS brand_key,
  CASE WHEN len(list_filter(toks, lambda t: t IN ({_in(T.SERVICE_WORDS)}) OR regexp_matches(t, '{"|".join(T.SERVICE_STEMS)}'))) > 0 THEN 'service'
    WHEN len(list_filter(toks, lambda t: t IN ({_in(T.ACCESSORY_WORDS)}) OR regexp_matches(t, '{"|".join(T.ACCESSORY_STEMS)}'))) > 0
      OR len(list_filter(spec_tokens, lambda s: s LIKE '%inch')) >= 2 OR regexp_matches(e, '[0-9]-[0-9]+inch') THEN 'accessory' ELSE 'device' END AS kind,
  list_max(list_transform(list_filter(spec_tokens, lambda s: regexp_matches(s, '^[0-9]+inch$')), lambda s: regexp_extract(s, '([0-9]+)inch$', 1)::INT)) AS screen_inches,
  list_max(list_transform(list_filter(spec_tokens, lambda s: regexp_matches(s, '^cap:[0-9]+gb$')), lambda s: regexp_extract(s, '([0-9]+)gb$', 1)::BIGINT)) AS capacity_gb FROM bodies)"""
)
_TRACKED = """, untracked AS (SELECT product_id, source, max(row(acted_at, seq)) AS cut FROM actions WHERE action = 'untrack' GROUP BY 1, 2),
tracked AS (SELECT a.product_id, a.source, min(a.acted_at) AS added_at FROM actions a LEFT JOIN untracked u USING (product_id, source)
  WHERE a.action IN ('track', 'alert') AND (u.cut IS NULL OR row(a.acted_at, a.seq) > u.cut) GROUP BY 1, 2)"""
_ALERTS = """, cleared AS (SELECT product_id, source, max(row(acted_at, seq)) AS cut FROM actions WHERE action = 'unalert' GROUP BY 1, 2),
alerts AS (SELECT a.product_id, a.source, arg_max_null(a.target_price, row(a.acted_at, a.seq)) AS target_price, min(a.acted_at) AS created_at FROM actions a LEFT JOIN cleared u USING (product_id, source)
  WHERE a.action = 'alert' AND (u.cut IS NULL OR row(a.acted_at, a.seq) > u.cut) GROUP BY 1, 2)"""
_KNOWN = ", known AS (SELECT product_id, source, concat('product ', product_id) AS name, concat('https://example.org/', source) AS url, price_euro, in_stock FROM latest)"
_REPORT = f"{common('actions', 'offers')}{_LATEST}{_ALERTS}{_KNOWN}, report AS (SELECT product_id, source, target_price, created_at, name, url, price_euro AS current_price, coalesce(price_euro > 0 AND price_euro <= target_price, false) AS triggered FROM alerts LEFT JOIN known USING (product_id, source))"
_PRODUCTS = """, products AS (SELECT product_id, source, arg_max_null(name, row(recorded_at, seq)) AS name, arg_max_null(url, row(recorded_at, seq)) AS url,
  arg_max(image_url, row(recorded_at, seq)) FILTER (WHERE image_url IS NOT NULL) AS image_url, arg_max(ean, row(recorded_at, seq)) FILTER (WHERE ean IS NOT NULL) AS ean,
  arg_max(sku, row(recorded_at, seq)) FILTER (WHERE sku IS NOT NULL) AS sku, arg_max(brand, row(recorded_at, seq)) FILTER (WHERE brand IS NOT NULL) AS brand,
  min(recorded_at) AS first_seen, max(recorded_at) AS last_seen FROM sightings GROUP BY 1, 2)"""
_BOTH = "FROM signed a JOIN signed b ON a.query_id = b.query_id AND a.arrival < b.arrival"
_SHARED = "(a.ean_key = b.ean_key OR a.sku_key = b.sku_key OR len(list_intersect(a.model_tokens, b.model_tokens)) > 0)"
_SCORES = f"""{_SIGNED}, pairs AS (SELECT a.query_id, a.arrival AS a, b.arrival AS b, a.ean_key AS ea, b.ean_key AS eb, a.sku_key AS sa, b.sku_key AS sb,
  (a.qualifiers <> b.qualifiers OR coalesce(a.capacity_gb <> b.capacity_gb, false) OR coalesce(a.screen_inches <> b.screen_inches, false)
    OR (len(a.spec_tokens) > 0 AND len(b.spec_tokens) > 0 AND len(list_intersect(a.spec_tokens, b.spec_tokens)) = 0)
    OR (len(a.model_tokens) > 0 AND len(b.model_tokens) > 0 AND len(list_intersect(a.model_tokens, b.model_tokens)) = 0)) AS vetoed,
  CASE WHEN least(len(a.model_tokens), len(b.model_tokens)) = 0 THEN 0::DOUBLE ELSE len(list_intersect(a.model_tokens, b.model_tokens))::DOUBLE / least(len(a.model_tokens), len(b.model_tokens))::DOUBLE END
    * least(coalesce(list_max(list_transform(list_intersect(a.model_tokens, b.model_tokens), lambda t: length(t))), 0)::DOUBLE / 6::DOUBLE, 1::DOUBLE) AS model,
  CASE WHEN least(len(a.name_tokens), len(b.name_tokens)) = 0 THEN 0::DOUBLE ELSE len(list_intersect(a.name_tokens, b.name_tokens))::DOUBLE / least(len(a.name_tokens), len(b.name_tokens))::DOUBLE END AS name,
  CASE WHEN a.brand_key IS NULL OR b.brand_key IS NULL THEN 0.5::DOUBLE WHEN a.brand_key = b.brand_key THEN 1::DOUBLE ELSE 0::DOUBLE END AS brand {_BOTH} AND {_SHARED}),
scores AS (SELECT query_id, a, b, CASE WHEN ea = eb THEN 1::DOUBLE WHEN ea <> eb THEN NULL WHEN sa = sb THEN 0.97::DOUBLE WHEN vetoed THEN NULL ELSE 0.60::DOUBLE * model + 0.30::DOUBLE * name + 0.10::DOUBLE * brand END AS score,
  CASE WHEN ea = eb THEN 'ean' WHEN sa = sb THEN 'sku' WHEN model > 0 THEN 'model' ELSE 'name' END AS basis FROM pairs)"""

def _grouped(condition: str) -> str:
    """Grouping by a plain walk: listings one by one in order of arrival, then cluster pairs one by one in order."""
    return f"""{_SCORES.replace("WITH ", "WITH RECURSIVE ", 1)}, chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS pos FROM signed WHERE {condition}),
links AS MATERIALIZED (SELECT s.query_id, a.pos AS a, b.pos AS b, score, list_position(['ean', 'sku', 'model', 'name'], basis) - 1 AS k FROM scores s
  JOIN chosen a ON a.query_id = s.query_id AND a.arrival = s.a JOIN chosen b ON b.query_id = s.query_id AND b.arrival = s.b WHERE score >= 0.55),
near AS (SELECT query_id, b AS pos, list({{h: a, s: score, k: k}} ORDER BY a) AS l FROM links GROUP BY 1, 2),
steps AS MATERIALIZED (SELECT query_id, pos, coalesce(l, []) AS l FROM chosen LEFT JOIN near USING (query_id, pos)),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, []::BIGINT[] AS heads, []::DOUBLE[] AS means, []::BIGINT[] AS ks FROM chosen
  UNION ALL SELECT query_id, pos, list_append(heads, coalesce(c.h, pos)), list_append(means, coalesce(-c.m, 1)), list_append(ks, coalesce(c.k, 3)) FROM (
    SELECT w.query_id, s.pos, heads, means, ks, list_sort(list_filter(list_transform(list_distinct(list_transform(l, lambda e: heads[e.h])), lambda h: {{
      m: -list_sum(list_transform(list_filter(l, lambda e: heads[e.h] = h), lambda e: e.s)) / len(list_filter(heads, lambda x: x = h)), h: h,
      k: list_min(list_transform(list_filter(l, lambda e: heads[e.h] = h), lambda e: e.k)), fits: len(list_filter(l, lambda e: heads[e.h] = h)) = len(list_filter(heads, lambda x: x = h))}}), lambda c: c.fits))[1] AS c
    FROM walk w JOIN steps s ON s.query_id = w.query_id AND s.pos = w.pos + 1)),
ended AS (SELECT query_id, arg_max(heads, pos) AS heads, arg_max(means, pos) AS means, arg_max(ks, pos) AS ks FROM walk GROUP BY 1),
assign AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY pos) AS place FROM (SELECT query_id, unnest(heads) AS h, unnest(means) AS mean, unnest(ks) AS k, unnest(range(1, len(heads) + 1)) AS pos FROM ended)),
c AS (SELECT query_id, h, count(*) AS size, least(min(mean), 1) AS confidence, min(k) AS k FROM assign GROUP BY 1, 2),
across AS (SELECT l.query_id, least(x.h, y.h) AS i, greatest(x.h, y.h) AS j, count(*) AS n, min(score) AS w, min(l.k) AS k FROM links l JOIN assign x ON x.query_id = l.query_id AND x.pos = l.a
  JOIN assign y ON y.query_id = l.query_id AND y.pos = l.b WHERE x.h != y.h GROUP BY ALL),
g AS MATERIALIZED (SELECT across.* FROM across JOIN c x ON x.query_id = across.query_id AND x.h = i JOIN c y ON y.query_id = across.query_id AND y.h = j WHERE n = x.size * y.size),
merge AS (SELECT query_id, 1 AS step, list({{i: i, j: j}} ORDER BY i, j) AS e, []::STRUCT(i BIGINT, j BIGINT)[] AS own FROM g GROUP BY 1
  UNION ALL SELECT query_id, step + 1, e, CASE WHEN len(list_filter(own, lambda m: m.j = e[step].i OR m.j = e[step].j)) = 0
    AND len(list_filter(own, lambda m: m.i = e[step].i AND NOT list_contains(e, {{i: least(m.j, e[step].j), j: greatest(m.j, e[step].j)}}))) = 0 THEN list_append(own, e[step]) ELSE own END FROM merge WHERE step <= len(e)),
went AS (SELECT query_id, m.i AS root, m.j AS h, turn FROM (SELECT query_id, unnest(own) AS m, unnest(range(1, len(own) + 1)) AS turn FROM (SELECT query_id, arg_max(own, step) AS own FROM merge GROUP BY 1))),
r AS (SELECT c.*, coalesce(root, c.h) AS root, coalesce(turn, 0) AS turn FROM c LEFT JOIN went USING (query_id, h)),
whole AS (SELECT query_id, root, min(confidence) AS confidence, min(k) AS k FROM (SELECT query_id, root, confidence, k FROM r
  UNION ALL SELECT g.query_id, x.root, w, g.k FROM g JOIN r x ON x.query_id = g.query_id AND x.h = g.i JOIN r y ON y.query_id = g.query_id AND y.h = g.j AND y.root = x.root) GROUP BY 1, 2),
placed AS (SELECT ch.*, r.root, row_number() OVER (PARTITION BY ch.query_id, r.root ORDER BY turn, place) AS place FROM chosen ch JOIN assign s USING (query_id, pos) JOIN r ON r.query_id = ch.query_id AND r.h = s.h),
grouped AS (SELECT p.query_id, min(CASE WHEN pos = p.root THEN arrival END) AS head, arg_min(name, row(strlen(name), place)) AS name, count(DISTINCT source) AS retailer_count, count(*) AS offer_count, min(price_euro) AS cheapest, max(price_euro) AS highest,
  greatest(max(price_euro) - min(price_euro), 0) AS savings, any_value(confidence) AS confidence, ['ean', 'sku', 'model', 'name'][any_value(k) + 1] AS basis, string_agg(id, ',' ORDER BY price_euro, place) AS members
  FROM placed p JOIN whole USING (query_id, root) GROUP BY p.query_id, p.root)"""


_NUMBER = r"""CASE WHEN regexp_matches(k, '[0-9]') THEN try_cast(CASE WHEN regexp_extract(k, '([.,])[0-9]*$', 1) <> '' AND ((contains(k, '.') AND contains(k, ',')) OR length(regexp_extract(k, '[.,]([0-9]*)$', 1)) <> 3)
  THEN concat(regexp_replace(regexp_replace(k, '[.,][0-9]*$', ''), '[.,]', '', 'g'), '.', coalesce(nullif(regexp_extract(k, '[.,]([0-9]*)$', 1), ''), '0')) ELSE regexp_replace(k, '[.,]', '', 'g') END AS DOUBLE) END"""

_POWER = """p_partkey::VARCHAR AS id, trim(p_name) AS name, p_retailprice AS price_euro, 'https://www.power.fi' || CASE WHEN p_partkey % 3 <> 0 THEN '/x/p-' ELSE '/p-' END || p_partkey || '/' AS url,
  'https://media.power-cdn.net/img/l.jpg' AS image_url, p_partkey % 5 <> 0 AS in_stock, CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE 'b' END || p_partkey AS ean, p_type AS sku, p_brand AS brand"""

SQL = {
    "latest_price": f"{_OFFERS}{_LATEST} SELECT * FROM latest",
    "price_spread_by_product": f"{_OFFERS}{_LATEST} SELECT product_id, min(price_euro) AS cheapest, max(price_euro) AS highest, count(DISTINCT source) AS retailer_count, greatest(max(price_euro) - min(price_euro), 0) AS savings FROM latest GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "cheapest_offer_list": f"{_OFFERS}{_LATEST} SELECT product_id, string_agg(source, '>' ORDER BY price_euro, source) AS by_price, min(price_euro) AS cheapest FROM latest GROUP BY 1",
    "price_history_topn": f"{_OFFERS} SELECT product_id, source, price_euro, recorded_at, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id, source ORDER BY recorded_at DESC, seq DESC) AS rank FROM offers) WHERE rank <= 3",
    "price_history_of_product": f"{_OFFERS} SELECT * FROM offers WHERE product_id = '7' AND source = 'src3' ORDER BY recorded_at DESC, seq DESC LIMIT 30",
    "store_search_postings": f"{_SIGHTINGS}{_PRODUCTS} " + " UNION ALL ".join(
        f"(SELECT '{q}' AS query, product_id, source, name FROM products WHERE name ILIKE '%{q}%' OR product_id = '{q}' OR ean = '{q}' OR sku = '{q}' ORDER BY last_seen DESC, product_id, source LIMIT 40)" for q in ("AME 1", "na_e%12", "7", "e 3", "none such")
    ),
    "change_only_history": f"""{_SIGHTINGS}, folded AS (SELECT product_id, source, list_reduce(list_prepend([NULL::STRUCT(t TIMESTAMP, q BIGINT, p DOUBLE, s BOOLEAN)], list_transform(list({{t: recorded_at, q: seq, p: price_euro, s: in_stock}} ORDER BY recorded_at, seq), lambda x: [x])),
  lambda acc, x: CASE WHEN acc[-1] IS NULL OR abs(x[1].p - acc[-1].p) >= 50.0 OR x[1].s IS DISTINCT FROM acc[-1].s THEN list_concat(acc, x) ELSE acc END) AS kept FROM sightings WHERE price_euro > 0 GROUP BY 1, 2)
SELECT product_id, source, k.q AS seq, k.p AS price_euro, k.s AS in_stock FROM (SELECT product_id, source, unnest(kept) AS k FROM folded) WHERE k IS NOT NULL""",
    "incremental_history": f"""{_SIGHTINGS}, folded AS (SELECT product_id, source, list_reduce(list_prepend([NULL::STRUCT(t TIMESTAMP, q BIGINT, p DOUBLE, s BOOLEAN)], list_transform(list({{t: recorded_at, q: seq, p: price_euro, s: in_stock}} ORDER BY recorded_at, seq), lambda x: [x])),
  lambda acc, x: CASE WHEN acc[-1] IS NULL OR abs(x[1].p - acc[-1].p) >= 50.0 OR x[1].s IS DISTINCT FROM acc[-1].s THEN list_concat(acc, x) ELSE acc END) AS kept FROM sightings WHERE price_euro > 0 GROUP BY 1, 2)
SELECT product_id, source, k.q AS seq, k.p AS price_euro, k.s AS in_stock FROM (SELECT product_id, source, unnest(kept) AS k FROM folded) WHERE k IS NOT NULL""",
    "product_upsert": f"{_SIGHTINGS}{_PRODUCTS} SELECT * FROM products",
    "store_search": f"{_SIGHTINGS}{_PRODUCTS} SELECT product_id, source, name FROM products WHERE name ILIKE '%ame 1%' ORDER BY last_seen DESC, product_id, source LIMIT 50",
    "store_stats": f"{common('sightings', 'actions')}{_TRACKED} SELECT (SELECT count(*) FROM (SELECT DISTINCT product_id, source FROM sightings)) AS products, (SELECT count(*) FROM sightings) AS price_points, (SELECT count(*) FROM tracked) AS tracked",
    "stats_by_source": f'{_OFFERS} SELECT source, count(*) AS "count" FROM offers GROUP BY 1',
    "tracked": f"{_ACTIONS}{_TRACKED} SELECT * FROM tracked",
    "alerts": f"{_ACTIONS}{_ALERTS} SELECT * FROM alerts",
    "alerts_report": f"{_REPORT} SELECT * FROM report",
    "alerts_report_stored": f"{_REPORT} SELECT * FROM report",
    "alerts_triggered": f"{_REPORT} SELECT product_id, source, current_price, target_price FROM report WHERE triggered",
    "tracked_report": f"{common('actions', 'offers')}{_LATEST}{_TRACKED}{_KNOWN} SELECT product_id, source, added_at, name, url, price_euro, in_stock FROM tracked LEFT JOIN known USING (product_id, source)",
    "fold_text": f"{_SIGNED} SELECT id, e AS folded FROM signed",
    "tokenize": f"{_SIGNED} SELECT id, array_to_string(toks, ' ') AS tokens FROM signed",
    "signature_sets": f"{_SIGNED} SELECT id, array_to_string(spec_tokens, '|') AS spec_tokens, array_to_string(model_tokens, '|') AS model_tokens, array_to_string(name_tokens, '|') AS name_tokens, array_to_string(qualifiers, '|') AS qualifiers FROM signed",
    "attributes": f"{_SIGNED} SELECT id, kind, screen_inches, capacity_gb, brand_key FROM signed",
    "described_attributes": f"""{_SIGNED}, w AS (SELECT id, concat_ws(', ', concat(screen_inches::VARCHAR || '"'), CASE WHEN screen_inches IS NULL THEN NULL END, CASE WHEN capacity_gb >= 1000 AND capacity_gb % 1000 = 0 THEN (capacity_gb // 1000) || ' TB' ELSE capacity_gb || ' GB' END,
  nullif(array_to_string(qualifiers, ', '), ''), CASE WHEN kind <> 'device' THEN kind END) AS w FROM (SELECT *, 1 AS one FROM signed)) SELECT id, CASE WHEN w = '' THEN '' ELSE '  [' || w || ']' END AS words FROM w""".replace("concat(screen_inches::VARCHAR || '\"'), CASE WHEN screen_inches IS NULL THEN NULL END", "screen_inches::VARCHAR || '\"'"),
    "sku_brand_normalize": f"{_SIGNED} SELECT id, sku_key, nullif(trim(regexp_replace({_FOLD.format('brand')}, '[^a-z0-9 ]', '', 'g')), '') AS brand_key FROM signed",
    "filter_price": f"{_TITLES} SELECT id FROM titles WHERE price_euro >= 950 AND price_euro <= 1500",
    "filter_stock": f"{_TITLES} SELECT id FROM titles WHERE in_stock",
    "filter_devices": f"{_SIGNED} SELECT id FROM signed WHERE kind = 'device'",
    "filter_brand": f"{_SIGNED} SELECT id FROM signed WHERE contains(coalesce(brand_key, ''), 'samsung') OR list_contains(name_tokens, 'samsung')",
    "filter_inches": f"{_SIGNED} SELECT id FROM signed WHERE screen_inches BETWEEN 20 AND 40",
    "filter_noop": f"{_TITLES} SELECT id FROM titles",
    "filter_dropped_count": f"{_SIGNED} SELECT count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM (SELECT coalesce(price_euro <= 1000 AND in_stock AND screen_inches >= 10, false) AS ok FROM signed)",
    "gtin_normalize": f"""{_TITLES_EAN}, raws AS (SELECT id, ean, ean AS raw, 'a' AS k FROM listings UNION ALL SELECT id, ean, CASE WHEN arrival % 2 = 0 THEN substr(ean, 2, 12) ELSE '1' || ean END, 'b' FROM listings),
gtins AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS gd FROM raws),
bodies AS (SELECT *, CASE length(gd) WHEN 8 THEN gd WHEN 12 THEN concat('0', gd) WHEN 13 THEN gd WHEN 14 THEN substr(gd, 2) END AS gb FROM gtins),
held AS (SELECT *, {_GTIN} AS g FROM bodies) SELECT id, any_value(ean) AS ean, max(CASE WHEN k = 'a' THEN g END) AS gtin, max(CASE WHEN k = 'b' THEN g END) AS gtin_other FROM held GROUP BY id""",
    "url_encode": f"{_TITLES} SELECT id, replace(url_encode(name), '%20', '+') AS encoded FROM titles",
    "blocking_candidates": f"{_SIGNED} SELECT a.query_id, a.arrival AS a, b.arrival AS b {_BOTH} AND {_SHARED}",
    "pair_scores": f"{_SCORES} SELECT * FROM scores WHERE score IS NOT NULL",
    "match_groups": f"{_grouped('true')} SELECT * FROM grouped",
    "group_attributes": f"""{_grouped("true")}, best AS (SELECT query_id, root, arg_max(pos, row((screen_inches IS NOT NULL)::INT + (capacity_gb IS NOT NULL)::INT + (brand_key IS NOT NULL)::INT, place)) AS pos, min(CASE WHEN pos = root THEN arrival END) AS head FROM placed GROUP BY 1, 2)
SELECT query_id, head, brand_key AS brand, screen_inches, capacity_gb, array_to_string(qualifiers, ',') AS qualifiers, kind FROM best JOIN placed USING (query_id, root, pos)""",
    "match_groups_multi": f"""{_grouped("kind = 'device'")} SELECT query_id, head, retailer_count, cheapest FROM grouped WHERE retailer_count > 1""",
    "parse_price": f"{_PRICES} SELECT seq, {_NUMBER} AS price_euro FROM (SELECT seq, regexp_replace(raw_price, '[^0-9.,]', '', 'g') AS k FROM prices)",
    "parse_stock": f"{_PRICES} SELECT seq, CASE WHEN trim(s) = '' THEN NULL WHEN regexp_matches(s, '{'|'.join(S.OUT_OF_STOCK)}') THEN false WHEN regexp_matches(s, '{'|'.join(S.IN_STOCK)}') THEN true END AS in_stock FROM (SELECT seq, lower(raw_stock) AS s FROM prices)",
    "absolute_url": f"{_PRICES} SELECT seq, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '//%' THEN 'https:' || h WHEN h LIKE '/%' THEN 'https://x.fi' || h ELSE 'https://x.fi/' || h END AS url FROM (SELECT seq, trim(href) AS h FROM prices)",
    "price_stock_labels": f"{_OFFERS} SELECT seq, printf('%.2f EUR', floor(price_euro)) AS price, CASE WHEN in_stock IS NULL THEN 'stock unknown' WHEN in_stock THEN 'in stock' ELSE 'out of stock' END AS stock, CASE WHEN in_stock THEN 'yes' ELSE 'no' END AS yes FROM offers",
    "squeeze_text": "SELECT doc_id, trim(regexp_replace(text, '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS squeezed FROM documents",
    "url_ids": "SELECT page_id, page_id::VARCHAR AS id_verkkokauppa, page_id::VARCHAR AS id_power, 'x' AS id_proshop, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*[0-9A-Za-z][^/]*)/*$', 1), '') AS id_segment FROM pages",
    "source_resolve": "SELECT s_suppkey, raw, CASE s_suppkey % 6 WHEN 0 THEN 'jimms' WHEN 1 THEN 'power' WHEN 2 THEN 'proshop' WHEN 5 THEN 'gigantti' END AS source FROM (SELECT s_suppkey, [' JIMMS ', 'www.power.fi', 'proshop.fi', 'amazon', '', 'Gigantti'][s_suppkey % 6 + 1] AS raw FROM supplier)",
    "sources_catalog": "SELECT t.*, (SELECT count(*) FROM supplier WHERE CASE s_suppkey % 6 WHEN 0 THEN 'jimms' WHEN 1 THEN 'power' WHEN 2 THEN 'proshop' END = t.id) AS suppliers FROM (VALUES " + ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {r[8]}, {str(r[10]).lower()})" for r in ROWS if r[5]) + ") AS t(rank, id, name, domain, page_cap, disallowed)",
    "fan_out_union": f"{_TITLES} SELECT source, count(*) AS n, sum(arrival)::BIGINT AS arrivals FROM titles GROUP BY 1",
    "per_source_limit": f"{_TITLES} SELECT query_id, source, arrival FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY arrival) AS r FROM titles) WHERE r <= 2",
    "enrich_missing": f"""{_TITLES_EAN}, due AS (SELECT *, ean IS NULL AND row_number() OVER (PARTITION BY query_id, ean IS NULL ORDER BY arrival) <= 12 AS d, arrival % 4 <> 3 AS page FROM listings)
SELECT query_id, arrival, coalesce(ean, CASE WHEN d AND page AND arrival % 5 <> 0 THEN 'e' || id END) AS ean, coalesce(sku, CASE WHEN d AND page AND arrival % 8 = 0 THEN 's' || id END) AS sku,
  coalesce(brand, CASE WHEN d AND page AND (arrival % 5 <> 0 OR arrival % 8 = 0) THEN 'brand' END) AS brand, d AND page AND (arrival % 5 <> 0 OR arrival % 8 = 0) AS enriched FROM due""",
    "verkkokauppa_product_replies": """SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE 'en ' || p_name END AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice ELSE 0 END AS price_euro,
  'https://www.verkkokauppa.com' || CASE WHEN p_partkey % 3 <> 0 THEN '/p/' || p_partkey ELSE '/en/' || p_partkey END AS url, 'large' || p_partkey AS image_url, NULL::BOOLEAN AS in_stock, 'e' || p_partkey AS ean, 'm' || p_partkey AS sku, p_brand AS brand
FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0""",
    "power_product_replies": f"SELECT {_POWER} FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0",
    "power_search_replies": f"SELECT p_partkey::VARCHAR AS query_id, 1::INTEGER AS rank, {_POWER} FROM part WHERE p_partkey % 11 <> 0",
    "jimms_search_replies": """SELECT p_partkey::VARCHAR AS id, 'Acme ' || trim(p_name) AS name, p_retailprice AS price_euro,
  'https://www.jimms.fi/fi/' || CASE WHEN p_partkey % 3 <> 0 THEN 'Product/' ELSE 'Product/Show/' END || p_partkey AS url, 'https://i/' || p_partkey || '-ig400gg.jpg' AS image_url, p_type AS sku, 'Acme' AS brand FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""",
    "backoff_schedule": "SELECT n_nationkey AS attempt, CASE WHEN n_nationkey % 5 = 4 THEN least(n_nationkey * 3, 20)::DOUBLE ELSE least(pow(2::DOUBLE, least(greatest(n_nationkey - 1, 0), 16)), 20::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * (n_regionkey / 4.0)::DOUBLE) END AS seconds FROM nation",
    "delays": "SELECT s_suppkey, least(greatest(s_acctbal, 0::DOUBLE), 3600::DOUBLE) AS seconds FROM supplier",
    "events_json_props": "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "refresh_outcome": f"{common('actions', 'offers')}{_LATEST}{_TRACKED} SELECT count(*) AS total, count(price_euro) AS updated, count(*) - count(price_euro) AS errors FROM tracked LEFT JOIN latest USING (product_id, source)",
}
SQL["price_history_oldest_first"] = f"""WITH points AS ({SQL["change_only_history"]}), best AS (SELECT product_id, source FROM points GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1),
newest AS (SELECT * FROM points JOIN best USING (product_id, source) ORDER BY seq DESC LIMIT 30) SELECT product_id, source, seq, price_euro, row_number() OVER (ORDER BY seq)::INTEGER AS turn FROM newest"""
