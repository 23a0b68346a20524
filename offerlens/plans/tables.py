"""Offers, titles, sightings and logs of events, derived from the star-schema tables.

The base views are one SQL text for both engines; everything computed on top is written twice, as DataFrames and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..folders import spread

BASE = {
    "offers": """
SELECT cast(l_partkey AS string) AS product_id, concat('src', cast(l_suppkey % 7 AS string)) AS source, l_extendedprice / l_quantity AS price_euro,
  CASE l_returnflag WHEN 'N' THEN true WHEN 'R' THEN false END AS in_stock, l_shipdate AS recorded_at,
  l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS seq
FROM lineitem""",
    "titles": """
SELECT concat('q', cast(cast(floor(p_partkey / 50) AS bigint) AS string)) AS query_id, p_partkey AS arrival, cast(p_partkey AS string) AS id, concat('src', cast(p_partkey % 7 AS string)) AS source,
  concat(CASE WHEN p_partkey % 3 = 0 THEN 'Samsung ' WHEN p_partkey % 3 = 1 THEN 'Näyttö ' ELSE 'ASUS ' END, p_name,
    CASE p_partkey % 5 WHEN 0 THEN ' 990 PRO' WHEN 1 THEN ' RTX 4070 Ti' WHEN 2 THEN ' i5-13600K' WHEN 3 THEN ' SN850X M.2 2280 x4' ELSE ' U80' END,
    ' ', cast(p_size AS string), CASE p_partkey % 4 WHEN 0 THEN ' Tt' WHEN 1 THEN '" televisio' WHEN 2 THEN '00GB' ELSE ' tuuman' END,
    CASE p_partkey % 11 WHEN 0 THEN ' seinäteline' WHEN 1 THEN ' asennus' WHEN 2 THEN ' jäähdytyssiili' WHEN 3 THEN ' ilman jäähdytyssiiliä' WHEN 4 THEN ' 32-55" stand' ELSE '' END) AS name,
  p_retailprice AS price_euro, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS in_stock, concat('https://example.org/p/', cast(p_partkey AS string)) AS url,
  CASE WHEN p_partkey % 6 = 0 THEN concat('64', lpad(cast(cast((p_partkey - p_partkey % 12) / 12 AS bigint) AS string), 10, '0')) WHEN p_partkey % 6 = 1 THEN '' END AS ean0,
  CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, '-', cast(p_size AS string)) END AS sku, CASE WHEN p_partkey % 2 = 0 THEN concat(p_brand, ' Öy') END AS brand
FROM part""",
    "sightings": """
SELECT cast(user_id AS string) AS product_id, event_type AS source, value AS price_euro, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS in_stock,
  ts AS recorded_at, event_id AS seq, concat('name ', cast(event_id % 13 AS string)) AS name, concat('https://example.org/', cast(event_id AS string)) AS url,
  CASE WHEN event_id % 7 = 0 THEN concat('img', cast(event_id AS string)) END AS image_url, CASE WHEN event_id % 11 = 0 THEN concat('e', cast(event_id AS string)) END AS ean,
  CASE WHEN event_id % 5 = 0 THEN concat('s', cast(event_id AS string)) END AS sku, CASE WHEN event_id % 17 = 0 THEN 'b' END AS brand
FROM events""",
    "actions": """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'track' WHEN 1 THEN 'alert' WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'untrack' ELSE 'alert' END ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'unalert' ELSE 'track' END END AS action,
  cast(o_custkey AS string) AS product_id, concat('src', cast(o_orderkey % 7 AS string)) AS source, o_totalprice / 100 AS target_price, o_orderdate AS acted_at, o_orderkey AS seq
FROM orders""",
    "prices": """
SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS seq,
  CASE l_linenumber % 7 WHEN 0 THEN concat(cast(cast(floor(l_extendedprice) AS bigint) AS string), ',-') WHEN 1 THEN concat(cast(cast(floor(l_quantity) AS bigint) AS string), ' 299,90 €') WHEN 2 THEN concat('1.', lpad(cast(l_orderkey % 1000 AS string), 3, '0'))
    WHEN 3 THEN concat('1,', lpad(cast(l_orderkey % 1000 AS string), 3, '0'), '.50') WHEN 4 THEN concat('alk. ', cast(cast(floor(l_quantity) AS bigint) AS string), ',5') WHEN 5 THEN 'ei tiedossa' ELSE cast(cast(floor(l_extendedprice) AS bigint) AS string) END AS raw_price,
  CASE l_suppkey % 9 WHEN 0 THEN 'Varastossa' WHEN 1 THEN 'Heti toimitukseen' WHEN 2 THEN 'Ei varastossa' WHEN 3 THEN 'Tilapäisesti loppu' WHEN 4 THEN 'Saatavilla toimittajalta' WHEN 5 THEN '???' WHEN 6 THEN ' ' WHEN 7 THEN 'Out of Stock' ELSE 'In stock' END AS raw_stock,
  CASE l_partkey % 5 WHEN 0 THEN '//cdn.example.org/i.jpg' WHEN 1 THEN '/a/b' WHEN 2 THEN 'c?d=1' WHEN 3 THEN ' https://example.org/x ' ELSE 'http://example.org' END AS href
FROM lineitem""",
}
SOURCES = {"offers": "lineitem", "titles": "part", "sightings": "events", "actions": "orders", "prices": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base view over its table."""
    source = SOURCES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name == "titles":  # much is read from a title
        rows = spread(rows, "p_partkey")
    return spark.sql(BASE[name].replace(f"FROM {source}", "FROM {source}"), source=rows)


def common(*names: str) -> str:
    """The base views as the head of a SQL query."""
    return "WITH " + ", ".join(f"{n} AS ({BASE[n]})" for n in names)
