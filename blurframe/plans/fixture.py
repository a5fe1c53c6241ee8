"""``orders_rt``: the star schema's orders as a table with relational columns and a basket.

One row per order that has a line. Columns: price (numeric), nation, priority
and status (categorical), basket (the distinct part names of its lines).
Hierarchies: nations by region, parts by noun, priorities and statuses under
one root. ``group_id`` is the customer, so groups are of a natural size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hierarchy import Hierarchy
from ..operators.encode import Hierarchies, encode
from ..schema import RTSchema
from ..scratch import table

SCHEMA = RTSchema((("price", "n"), ("nation", "c"), ("priority", "c"), ("status", "c"), ("basket", "t")))
ROOT = "*"


@dataclass
class Fixture:
    schema: RTSchema
    hierarchies: Hierarchies
    rows: DataFrame

    @property
    def encoded(self) -> DataFrame:
        return encode(self.rows, self.schema, self.hierarchies, validate=False)


def hierarchies(spark: SparkSession, sf_dir: str) -> Hierarchies:
    """The four hierarchies, from the dimension tables and from the distinct values of two columns of orders."""
    nation, region, part, orders = (table(spark, sf_dir, t) for t in ("nation", "region", "part", "orders"))
    root = F.lit(ROOT)
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    edges = [
        region.select(F.lit("nation").alias("attr"), root.alias("parent"), F.col("r_name").alias("child")),
        nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("nation"), "r_name", "n_name"),
        part.select(F.lit("basket"), root, noun),
        part.select(F.lit("basket"), noun, "p_name"),
        orders.select(F.lit("priority"), root, "o_orderpriority"),
        orders.select(F.lit("status"), root, "o_orderstatus"),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    found: dict[str, list[tuple[str, str]]] = {}
    for r in every.distinct().collect():  # as many rows as the hierarchies have edges
        found.setdefault(r["attr"], []).append((r["parent"], r["child"]))
    return {name: Hierarchy(e, name) for name, e in found.items()}


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, group_id and the schema's columns as labels."""
    orders, customer, nation, lines, part = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem", "part"))
    names = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name")
    baskets = names.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("basket"))
    people = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = orders.join(baskets, F.col("o_orderkey") == F.col("l_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_totalprice").alias("price"),
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        "basket",
    )


def load(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(SCHEMA, hierarchies(spark, sf_dir), rows(spark, sf_dir))


#: The same in SQL: ``ids`` (attr, label, parent, depth, node), ``closure``, ``leafs``, ``rt`` and ``enc``.
SQL = """
bk AS (SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS labels FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
rt AS (
  SELECT o_orderkey AS row_id, o_custkey AS group_id, o_totalprice AS price, n_name AS nation, r_name AS region, o_orderpriority AS priority, o_orderstatus AS status, labels
  FROM orders JOIN bk ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
tree AS (
  SELECT DISTINCT * FROM (
    SELECT a.attr, '*' AS label, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM (VALUES ('nation'), ('priority'), ('status'), ('basket')) a(attr)
    UNION ALL SELECT 'nation', r_name, '*', 1 FROM region
    UNION ALL SELECT 'nation', n_name, r_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'priority', o_orderpriority, '*', 1 FROM orders
    UNION ALL SELECT 'status', o_orderstatus, '*', 1 FROM orders
    UNION ALL SELECT 'basket', split_part(p_name, ' ', 2), '*', 1 FROM part
    UNION ALL SELECT 'basket', p_name, split_part(p_name, ' ', 2), 2 FROM part
  )
),
ids AS (SELECT *, CAST(row_number() OVER (PARTITION BY attr ORDER BY depth, label) - 1 AS INTEGER) AS node FROM tree),
links AS (SELECT c.attr, c.node AS child, p.node AS parent FROM ids c JOIN ids p ON c.attr = p.attr AND c.parent = p.label),
closure AS (
  SELECT attr, node AS ancestor, node, 0 AS distance FROM ids
  UNION ALL SELECT attr, parent, child, 1 FROM links
  UNION ALL SELECT a.attr, b.parent, a.child, 2 FROM links a JOIN links b ON a.attr = b.attr AND a.parent = b.child
),
leafs AS (
  SELECT i.attr, i.node, CAST(count(l.node) FILTER (WHERE c.node <> i.node) AS INTEGER) AS leaf_cnt
  FROM ids i JOIN closure c ON c.attr = i.attr AND c.ancestor = i.node
  LEFT JOIN (SELECT attr, node FROM ids WHERE (attr, node) NOT IN (SELECT attr, parent FROM links)) l ON l.attr = c.attr AND l.node = c.node
  GROUP BY i.attr, i.node
),
frac AS (SELECT attr, node, leaf_cnt, leaf_cnt / CAST(max(leaf_cnt) OVER (PARTITION BY attr) AS DOUBLE) AS leaf_frac FROM leafs),
item_ids AS (SELECT row_id, list_sort(list(node)) AS items FROM (SELECT row_id, unnest(labels) AS label FROM rt) JOIN ids USING (label) WHERE attr = 'basket' GROUP BY row_id),
enc AS (
  SELECT rt.row_id, rt.group_id, price, a.node AS region, b.node AS nation, c.node AS priority, d.node AS status, items
  FROM rt JOIN ids a ON a.attr = 'nation' AND a.label = rt.region JOIN ids b ON b.attr = 'nation' AND b.label = rt.nation
  JOIN ids c ON c.attr = 'priority' AND c.label = rt.priority JOIN ids d ON d.attr = 'status' AND d.label = rt.status JOIN item_ids ON item_ids.row_id = rt.row_id
),
dom AS (SELECT max(price) - min(price) AS width FROM rt),
grp AS (
  SELECT group_id, count(*) AS n_rows, min(price) AS lo, max(price) AS hi,
    CASE WHEN min(nation) = max(nation) THEN min(nation) WHEN min(region) = max(region) THEN min(region) ELSE 0 END AS nation,
    CASE WHEN min(priority) = max(priority) THEN min(priority) ELSE 0 END AS priority,
    CASE WHEN min(status) = max(status) THEN min(status) ELSE 0 END AS status
  FROM enc GROUP BY group_id
),
grp_ncp AS (
  SELECT grp.*, (0.0 + a.leaf_frac + b.leaf_frac + c.leaf_frac + CASE WHEN hi > lo THEN (hi - lo) / (SELECT width FROM dom) ELSE 0.0 END) * n_rows AS ncp
  FROM grp JOIN frac a ON a.attr = 'nation' AND a.node = grp.nation JOIN frac b ON b.attr = 'priority' AND b.node = grp.priority JOIN frac c ON c.attr = 'status' AND c.node = grp.status
)
"""
