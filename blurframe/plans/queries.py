"""Registered queries over ``orders_rt``, each on the whole table, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import btd, gain, lca_of_paths, ncp_ul_ratio, related_paths
from ..operators import cluster, items, merge, verify
from ..operators.encode import decode, domains
from ..operators.generalize import coalesce_classes, dataset_ncp, generalize, group_ncp, group_table, row_ncp
from ..operators.neighbors import PairCost, nearest
from ..operators.order import dense_ranks
from ..schema import Params
from ..scratch import materialize
from ..sources.text import format_rows
from . import fixture, pipeline

K, M = 40, 2
CENTERS, TREE, TOP = 25, 5, 50
CLASS = ["c_status", "c_priority", "c_nation"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name; ``sql`` follows the fixture's common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{fixture.SQL}{sql}"
        return f

    return add


def _text(column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


_LIST = "array_to_string(CAST({0} AS VARCHAR[]), ' ')"
_ITEMS = _LIST.format("items")
_UL = ", ".join(f"({u}, '{2**u - 1 if u else 0}'::HUGEINT)" for u in range(101))

# encoding and hierarchies -----------------------------------------------------------------


@query(f"SELECT row_id, price AS lo, price AS hi, nation, priority, status, {_ITEMS} AS items FROM enc")
def encode_rows(spark, sf_dir):
    e = fixture.load(spark, sf_dir).encoded
    return e.select("row_id", F.col("n_price_lo").alias("lo"), F.col("n_price_hi").alias("hi"), F.col("c_nation").alias("nation"), F.col("c_priority").alias("priority"), F.col("c_status").alias("status"), _text("items").alias("items"))


@query("SELECT row_id, nation, priority, status, array_to_string(list_sort(labels), ';') AS basket FROM rt")
def encode_roundtrip(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    d = decode(f.encoded, f.schema, f.hierarchies)
    return d.select("row_id", "nation", "priority", "status", F.array_join("basket", ";").alias("basket"))


@query("""SELECT i.attr, i.node, i.label, coalesce(p.node, -1) AS parent, i.depth, leaf_cnt, leaf_frac, CAST(w.w AS VARCHAR) AS ul_weight
FROM ids i LEFT JOIN ids p ON p.attr = i.attr AND p.label = i.parent JOIN frac f ON f.attr = i.attr AND f.node = i.node JOIN (VALUES %s) w(u, w) ON w.u = leaf_cnt""" % _UL)
def hierarchy_nodes(spark, sf_dir):
    hs = fixture.hierarchies(spark, sf_dir)
    cols = ["attr", "node", "label", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "leaf_cnt", "leaf_frac", F.col("ul_weight").cast("string").alias("ul_weight")]
    parts = [h.to_df(spark).select(*cols) for _, h in sorted(hs.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _paths(spark, sf_dir):
    hs = fixture.hierarchies(spark, sf_dir)
    parts = [h.to_df(spark).select("attr", "node", "path") for _, h in sorted(hs.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PAIRS = "ids a JOIN ids b ON a.attr = b.attr AND a.node <= b.node"


@query(f"""SELECT a.attr, a.node AS a, b.node AS b, max_by(c.ancestor, i.depth) AS lca FROM {_PAIRS}
JOIN closure c ON c.attr = a.attr AND c.node = a.node JOIN closure d ON d.attr = b.attr AND d.node = b.node AND d.ancestor = c.ancestor
JOIN ids i ON i.attr = c.attr AND i.node = c.ancestor GROUP BY 1, 2, 3""")
def hierarchy_lca_pairs(spark, sf_dir):
    p = _paths(spark, sf_dir)
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.attr") == F.col("b.attr")) & (F.col("a.node") <= F.col("b.node")))
    return pairs.select("a.attr", F.col("a.node").alias("a"), F.col("b.node").alias("b"), lca_of_paths(F.col("a.path"), F.col("b.path")).alias("lca"))


@query(f"""SELECT a.attr, a.node AS a, b.node AS b, EXISTS (SELECT 1 FROM closure c WHERE c.attr = a.attr AND ((c.ancestor = a.node AND c.node = b.node) OR (c.ancestor = b.node AND c.node = a.node))) AS related FROM {_PAIRS}""")
def hierarchy_related(spark, sf_dir):
    p = _paths(spark, sf_dir)
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.attr") == F.col("b.attr")) & (F.col("a.node") <= F.col("b.node")))
    return pairs.select("a.attr", F.col("a.node").alias("a"), F.col("b.node").alias("b"), related_paths(F.col("a.path"), F.col("a.node"), F.col("b.path"), F.col("b.node")).alias("related"))


@query(f"SELECT attr, ancestor AS node, {_LIST.format('list_sort(list(node))')} AS replaced FROM closure WHERE distance > 0 GROUP BY 1, 2")
def hierarchy_cut(spark, sf_dir):
    out = None
    for name, h in sorted(fixture.hierarchies(spark, sf_dir).items()):
        below = h.closure(spark).where("distance > 0").groupBy(F.col("ancestor").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("r"))
        one = below.select(F.lit(name).alias("attr"), "node", _text("r").alias("replaced"))
        out = one if out is None else out.unionByName(one)
    return out


# generalization and relational loss --------------------------------------------------------


@query("SELECT group_id, n_rows, lo, hi, nation, priority, status FROM grp")
def group_generalize(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    g = group_table(f.encoded, f.schema, f.hierarchies)
    return g.select("group_id", "n_rows", F.col("n_price_lo").alias("lo"), F.col("n_price_hi").alias("hi"), F.col("c_nation").alias("nation"), F.col("c_priority").alias("priority"), F.col("c_status").alias("status"))


def _groups(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    e = f.encoded
    domain = domains(e, f.schema)
    return f, e, domain, group_ncp(group_table(e, f.schema, f.hierarchies), f.schema, f.hierarchies, domain)


@query("SELECT group_id, round(ncp, 6) AS ncp FROM grp_ncp")
def group_loss(spark, sf_dir):
    _, _, _, g = _groups(spark, sf_dir)
    return g.select("group_id", F.round("ncp", 6).alias("ncp"))


@query("SELECT CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_groups, round(sum(ncp), 4) AS ncp, round(sum(ncp) / sum(n_rows) / 4, 6) AS ncp_readable FROM grp_ncp")
def dataset_loss(spark, sf_dir):
    f, _, _, g = _groups(spark, sf_dir)
    return dataset_ncp(g, f.schema).select("n_rows", "n_groups", F.round("ncp", 4).alias("ncp"), F.round("ncp_readable", 6).alias("ncp_readable"))


@query("""SELECT group_id, round((0.0 + CASE WHEN a.leaf_cnt > 1 THEN a.leaf_frac ELSE 0 END * 2.0 + CASE WHEN b.leaf_cnt > 1 THEN b.leaf_frac ELSE 0 END + CASE WHEN c.leaf_cnt > 1 THEN c.leaf_frac ELSE 0 END
 + CASE WHEN hi > lo THEN (hi - lo) / (SELECT width FROM dom) ELSE 0.0 END * 0.5) * n_rows / (SELECT count(*) FROM enc), 9) AS ncp
FROM grp JOIN frac a ON a.attr = 'nation' AND a.node = grp.nation JOIN frac b ON b.attr = 'priority' AND b.node = grp.priority JOIN frac c ON c.attr = 'status' AND c.node = grp.status""")
def group_loss_weighted(spark, sf_dir):
    """The serial measure: weighted columns, over the number of rows."""
    f = fixture.load(spark, sf_dir)
    schema = type(f.schema)(f.schema.columns, {"nation": 2.0, "price": 0.5})
    e = f.encoded
    domain = domains(e, schema)
    g = group_ncp(group_table(e, schema, f.hierarchies), schema, f.hierarchies, domain, serial_rows=e.count())
    return g.select("group_id", F.round("ncp", 9).alias("ncp"))


@query("""SELECT enc.row_id, enc.group_id, g.lo, g.hi, g.nation, g.priority, g.status, %s AS items FROM enc JOIN grp g USING (group_id)""" % _ITEMS.replace("items", "enc.items"))
def generalize_rows(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    g = generalize(f.encoded, f.schema, f.hierarchies)
    return g.select("row_id", "group_id", F.col("n_price_lo").alias("lo"), F.col("n_price_hi").alias("hi"), F.col("c_nation").alias("nation"), F.col("c_priority").alias("priority"), F.col("c_status").alias("status"), _text("items").alias("items"))


@query("""SELECT row_id, min(g.group_id) OVER (PARTITION BY lo, hi, nation, priority, status) AS class_id FROM (SELECT row_id, enc.group_id, g.lo, g.hi, g.nation, g.priority, g.status FROM enc JOIN grp g USING (group_id)) g""")
def coalesced_classes(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    c = coalesce_classes(generalize(f.encoded, f.schema, f.hierarchies), f.schema)
    return c.select("row_id", F.col("group_id").alias("class_id"))


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query(f"""SELECT concat_ws(',', CASE WHEN lo = hi THEN {_NUM.format("lo")} ELSE concat_ws('-', {_NUM.format("lo")}, {_NUM.format("hi")}) END, n.label, p.label, s.label, array_to_string(list_sort(rt.labels), ' ')) AS value
FROM rt JOIN grp g USING (group_id) JOIN ids n ON n.attr = 'nation' AND n.node = g.nation JOIN ids p ON p.attr = 'priority' AND p.node = g.priority JOIN ids s ON s.attr = 'status' AND s.node = g.status""")
def formatted_rows(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    return format_rows(decode(generalize(f.encoded, f.schema, f.hierarchies), f.schema, f.hierarchies), f.schema)


# classes, supports, rules ---------------------------------------------------------------------


@query("SELECT status, priority, nation, count(*) AS n_rows FROM enc GROUP BY ALL")
def class_sizes(spark, sf_dir):
    e = fixture.load(spark, sf_dir).encoded
    return verify.class_sizes(e, CLASS).select(F.col("c_status").alias("status"), F.col("c_priority").alias("priority"), F.col("c_nation").alias("nation"), "n_rows")


@query(f"SELECT status, priority, nation, count(*) AS n_rows FROM enc GROUP BY ALL HAVING count(*) < {K}")
def k_violations(spark, sf_dir):
    e = fixture.load(spark, sf_dir).encoded
    return verify.k_violations(e, CLASS, K).select(F.col("c_status").alias("status"), F.col("c_priority").alias("priority"), F.col("c_nation").alias("nation"), "n_rows")


_EXT = "ext AS (SELECT DISTINCT row_id, c.ancestor AS node FROM (SELECT row_id, unnest(items) AS item FROM enc) u JOIN closure c ON c.attr = 'basket' AND c.node = u.item)"


@query(f", {_EXT} SELECT CAST(node AS VARCHAR) AS itemset, count(*) AS support FROM ext GROUP BY node")
def item_support(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    return items.itemset_support(f.encoded, 1, f.hierarchies["basket"]).select(_text("itemset").alias("itemset"), "support")


@query(f""", {_EXT}, kin AS (SELECT ancestor AS a, node AS b FROM closure WHERE attr = 'basket')
SELECT concat_ws(' ', a.node, b.node) AS itemset, count(*) AS support FROM ext a JOIN ext b ON a.row_id = b.row_id AND a.node < b.node
WHERE (a.node, b.node) NOT IN (SELECT a, b FROM kin) GROUP BY a.node, b.node""")
def itemset_support_2(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    return items.itemset_support(f.encoded, 2, f.hierarchies["basket"]).select(_text("itemset").alias("itemset"), "support")


@query(""", u AS (SELECT row_id, unnest(items) AS item FROM enc)
SELECT concat_ws(' ', a.item, b.item, c.item) AS itemset, count(*) AS support FROM u a JOIN u b ON a.row_id = b.row_id AND a.item < b.item JOIN u c ON c.row_id = b.row_id AND b.item < c.item GROUP BY a.item, b.item, c.item""")
def itemset_support_3(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    return items.itemset_support(f.encoded, 3).select(_text("itemset").alias("itemset"), "support")


@query(f""", u AS (SELECT row_id, status, priority, nation, unnest(items) AS item FROM enc),
filled AS (SELECT status, priority, nation, count(*) AS filled FROM enc WHERE len(items) > 0 GROUP BY ALL),
sets AS (
  SELECT status, priority, nation, CAST(item AS VARCHAR) AS itemset, count(*) AS support FROM u GROUP BY ALL
  UNION ALL SELECT a.status, a.priority, a.nation, concat_ws(' ', a.item, b.item), count(*) FROM u a JOIN u b ON a.row_id = b.row_id AND a.item < b.item GROUP BY a.status, a.priority, a.nation, a.item, b.item
)
SELECT sets.*, filled < {K} AS hopeless FROM sets JOIN filled USING (status, priority, nation) WHERE support < {K}""")
def km_violations(spark, sf_dir):
    e = fixture.load(spark, sf_dir).encoded
    v = verify.km_violations(e, CLASS, K, M)
    return v.select(F.col("c_status").alias("status"), F.col("c_priority").alias("priority"), F.col("c_nation").alias("nation"), _text("itemset").alias("itemset"), "support", "hopeless")


@query(f"""SELECT row_id, {_LIST.format("list_sort(list_distinct(list(p)))")} AS items FROM (SELECT e.row_id, l.parent AS p FROM (SELECT row_id, unnest(items) AS item FROM enc) e JOIN links l ON l.attr = 'basket' AND l.child = e.item) GROUP BY row_id""")
def item_rules_apply(spark, sf_dir):
    """The cut at every noun, as rules in order."""
    f = fixture.load(spark, sf_dir)
    h = f.hierarchies["basket"]
    rules = [h.cut(n) for n in h.children(h.root)]
    return f.encoded.select("row_id", _text(items.apply_rules(F.col("items"), rules)).alias("items"))


@query(""", sib AS (SELECT a.child AS item, array_to_string(CAST(list_sort(list(b.child)) AS VARCHAR[]), ' ') AS s FROM links a JOIN links b ON a.attr = 'basket' AND b.attr = 'basket' AND a.parent = b.parent JOIN ids i ON i.attr = 'basket' AND i.node = a.child AND i.depth = 2 GROUP BY a.child)
SELECT row_id, array_to_string(list_sort(list_distinct(list('{' || s || '}'))), '') AS sets FROM (SELECT row_id, unnest(items) AS item FROM enc) JOIN sib USING (item) GROUP BY row_id""")
def set_map_apply(spark, sf_dir):
    """Each item replaced by the set of its siblings."""
    f = fixture.load(spark, sf_dir)
    h = f.hierarchies["basket"]
    of = {x: sorted(h.children(h.parent(x))) for x in h.leaves()}
    mapping = spark.createDataFrame([(list(of), list(of.values()))], "item array<int>, sets array<array<int>>").select(F.map_from_arrays("item", "sets").alias("mapping"))
    one = f.encoded.select("row_id", F.lit(0).cast("long").alias("group_id"), "items")
    done = items.apply_set_mapping(one, mapping.withColumn("group_id", F.lit(0).cast("long")))
    braces = F.array_sort(F.transform("item_sets", lambda s: F.concat(F.lit("{"), _text(s), F.lit("}"))))
    return done.select("row_id", F.array_join(braces, "").alias("sets"))


_NOUNS = "nouns AS (SELECT DISTINCT e.row_id, e.group_id, l.parent AS node FROM (SELECT row_id, group_id, unnest(items) AS item FROM enc) e JOIN links l ON l.attr = 'basket' AND l.child = e.item)"


@query(f""", {_NOUNS} SELECT group_id, CAST(sum(w.w) AS VARCHAR) AS ul FROM nouns JOIN leafs f ON f.attr = 'basket' AND f.node = nouns.node JOIN (VALUES {_UL}) w(u, w) ON w.u = f.leaf_cnt GROUP BY group_id""")
def ul_hierarchy(spark, sf_dir):
    """Item loss by customer when every item is its noun."""
    f = fixture.load(spark, sf_dir)
    h = f.hierarchies["basket"]
    up = F.lit([h.parent(i) if h.parent(i) is not None else i for i in range(h.size)])
    cut = f.encoded.withColumn("items", F.array_distinct(F.transform("items", lambda x: F.element_at(up, x + 1))))
    return items.ul_hierarchy(cut, h, ["group_id"]).withColumn("ul", F.col("ul").cast("string"))


@query(f""", {_NOUNS} SELECT group_id, CAST(sum(w.w) AS VARCHAR) AS ul FROM nouns JOIN leafs f ON f.attr = 'basket' AND f.node = nouns.node JOIN (VALUES {_UL}) w(u, w) ON w.u = f.leaf_cnt GROUP BY group_id""")
def ul_sets(spark, sf_dir):
    """Item loss by customer when every item is the set of its siblings."""
    f = fixture.load(spark, sf_dir)
    h = f.hierarchies["basket"]
    kin = F.lit([sorted(h.children(h.parent(i))) if h.is_leaf(i) else [] for i in range(h.size)])
    sets = f.encoded.withColumn("item_sets", F.array_distinct(F.transform("items", lambda x: F.element_at(kin, x + 1))))
    return items.ul_sets(sets, ["group_id"]).withColumn("ul", F.col("ul").cast("string"))


# distances and rankings ----------------------------------------------------------------------


@query("""SELECT a.row_id AS a, b.row_id AS b, (len(list_distinct(a.items || b.items)) - len(list_intersect(a.items, b.items)) + 1) * len(list_distinct(a.items || b.items)) / CAST(len(list_intersect(a.items, b.items)) + 1 AS DOUBLE) AS btd
FROM enc a JOIN enc b ON a.group_id = b.group_id AND a.row_id < b.row_id""")
def btd_pairs(spark, sf_dir):
    """Item distance of all orders of a customer."""
    e = fixture.load(spark, sf_dir).encoded.select("group_id", "row_id", "items")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.row_id") < F.col("b.row_id")))
    return pairs.select(F.col("a.row_id").alias("a"), F.col("b.row_id").alias("b"), btd(F.col("a.items"), F.col("b.items")).alias("btd"))


@query("""SELECT a.group_id, max((len(list_distinct(a.items || b.items)) - len(list_intersect(a.items, b.items)) + 1) * len(list_distinct(a.items || b.items)) / CAST(len(list_intersect(a.items, b.items)) + 1 AS DOUBLE)) AS btd
FROM enc a JOIN enc b ON a.group_id = b.group_id AND a.row_id < b.row_id GROUP BY 1""")
def btd_groups(spark, sf_dir):
    """Complete linkage: the largest item distance within a customer's orders."""
    e = fixture.load(spark, sf_dir).encoded.select("group_id", "row_id", "items")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.row_id") < F.col("b.row_id")))
    return pairs.groupBy(F.col("a.group_id").alias("group_id")).agg(F.max(btd(F.col("a.items"), F.col("b.items"))).alias("btd"))


_COST = """(0.0 + CASE WHEN {a}.nation = {b}.nation THEN na.leaf_frac WHEN {a}.region = {b}.region THEN nr.leaf_frac ELSE 1.0 END + CASE WHEN {a}.priority = {b}.priority THEN 0.0 ELSE 1.0 END + CASE WHEN {a}.status = {b}.status THEN 0.0 ELSE 1.0 END
 + CASE WHEN {a}.price <> {b}.price THEN (greatest({a}.price, {b}.price) - least({a}.price, {b}.price)) / (SELECT width FROM dom) ELSE 0.0 END)"""


@query(f""", ctr AS (SELECT * FROM enc ORDER BY row_id LIMIT {CENTERS}),
pairs AS (SELECT c.row_id AS center, e.row_id AS id, {_COST.format(a="e", b="c")} AS cost FROM enc e CROSS JOIN ctr c JOIN frac na ON na.attr = 'nation' AND na.node = e.nation JOIN frac nr ON nr.attr = 'nation' AND nr.node = e.region)
SELECT center, id, round(cost, 9) AS cost, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY cost, id) AS place FROM pairs) WHERE place <= {K + K // 2}""")
def pair_ncp_topk(spark, sf_dir):
    """One clustering round's search: the nearest rows of the first centers."""
    f = fixture.load(spark, sf_dir)
    e = materialize(f.encoded, "encoded")
    cost = PairCost.make(f.schema, f.hierarchies, domains(e, f.schema))
    found = nearest(e, cluster.next_centers(e, f.schema, CENTERS), cost, K + K // 2)
    return found.select("center", "id", F.round("cost", 9).alias("cost"), "place")


_CLASSES = "cls AS (SELECT min(row_id) AS id, status, priority, region, nation, count(*) AS n_rows, min(price) AS lo, max(price) AS hi FROM enc GROUP BY status, priority, region, nation)"


@query(f""", {_CLASSES}, pairs AS (
  SELECT s.id AS small, b.id AS large, (0.0 + CASE WHEN s.nation = b.nation THEN 0.0 WHEN s.region = b.region THEN nr.leaf_frac ELSE 1.0 END + CASE WHEN s.priority = b.priority THEN 0.0 ELSE 1.0 END + CASE WHEN s.status = b.status THEN 0.0 ELSE 1.0 END
    + CASE WHEN greatest(s.hi, b.hi) > least(s.lo, b.lo) THEN (greatest(s.hi, b.hi) - least(s.lo, b.lo)) / (SELECT width FROM dom) ELSE 0.0 END) AS cost
  FROM cls s JOIN cls b ON s.n_rows < {K} AND b.n_rows >= {K} JOIN frac nr ON nr.attr = 'nation' AND nr.node = s.region)
SELECT small, large, round(cost, 9) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY small ORDER BY cost, large) AS place FROM pairs) WHERE place = 1""")
def nearest_group(spark, sf_dir):
    """For every class that is too small, the large enough class that it extends least."""
    f = fixture.load(spark, sf_dir)
    e = f.encoded
    domain = domains(e, f.schema)
    named = e.drop("group_id").join(e.groupBy(*CLASS).agg(F.min("row_id").alias("group_id")), CLASS)
    groups = materialize(group_table(named, f.schema, f.hierarchies), "classes")
    cost = PairCost.make(f.schema, f.hierarchies, domain)
    found = nearest(groups.where(F.col("n_rows") >= K), groups.where(F.col("n_rows") < K), cost, 1, id_column="group_id")
    return found.select(F.col("center").alias("small"), F.col("id").alias("large"), F.round("cost", 9).alias("cost"))


_RATIO = f""", {_NOUNS}, gul AS (SELECT group_id, sum(w.w) AS ul FROM nouns JOIN leafs f ON f.attr = 'basket' AND f.node = nouns.node JOIN (VALUES {_UL}) w(u, w) ON w.u = f.leaf_cnt GROUP BY group_id),
ratio AS (SELECT group_id, CASE WHEN ul = 0 THEN 1e11 ELSE round(ncp, 6) / CAST(ul AS DOUBLE) END AS ratio FROM grp_ncp JOIN gul USING (group_id))"""


def _ratio(spark, sf_dir):
    _, _, _, g = _groups(spark, sf_dir)
    ul = ul_hierarchy(spark, sf_dir).withColumn("ul", F.col("ul").cast("decimal(38,0)"))
    return g.join(ul, "group_id").select("group_id", ncp_ul_ratio(F.round("ncp", 6), F.col("ul")).alias("ratio"))


@query(f"{_RATIO} SELECT group_id, round(ratio, 9) AS ratio FROM ratio ORDER BY ratio, group_id LIMIT {TOP}")
def ratio_top_m(spark, sf_dir):
    """The groups that a merge round takes as centers."""
    return merge.lowest(_ratio(spark, sf_dir), "ratio", TOP).select("group_id", F.round("ratio", 9).alias("ratio"))


_GROUP_COST = f"""gp AS (SELECT g.*, coalesce(l.parent, 0) AS p FROM grp_ncp g LEFT JOIN links l ON l.attr = 'nation' AND l.child = g.nation),
ctr AS (SELECT * FROM gp ORDER BY ncp, group_id LIMIT {TOP}),
pairs AS (
  SELECT c.group_id AS center, g.group_id AS id, g.ncp AS g_ncp, c.ncp AS c_ncp, (0.0 + fn.leaf_frac + CASE WHEN g.priority = c.priority THEN fp.leaf_frac ELSE 1.0 END + CASE WHEN g.status = c.status THEN fs.leaf_frac ELSE 1.0 END
    + CASE WHEN greatest(g.hi, c.hi) > least(g.lo, c.lo) THEN (greatest(g.hi, c.hi) - least(g.lo, c.lo)) / (SELECT width FROM dom) ELSE 0.0 END) * (g.n_rows + c.n_rows) AS merged
  FROM gp g CROSS JOIN ctr c
  JOIN frac fn ON fn.attr = 'nation' AND fn.node = CASE WHEN g.nation = c.nation THEN g.nation WHEN g.nation <> 0 AND c.nation <> 0 AND (CASE WHEN g.p = 0 THEN g.nation ELSE g.p END) = (CASE WHEN c.p = 0 THEN c.nation ELSE c.p END) THEN (CASE WHEN g.p = 0 THEN g.nation ELSE g.p END) ELSE 0 END
  JOIN frac fp ON fp.attr = 'priority' AND fp.node = g.priority JOIN frac fs ON fs.attr = 'status' AND fs.node = g.status
  WHERE g.group_id NOT IN (SELECT group_id FROM ctr)
)"""


@query(f""", {_GROUP_COST}
SELECT center, id, round(cost, 6) AS cost, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY cost, id) AS place FROM (SELECT center, id, merged - g_ncp - c_ncp AS cost FROM pairs)) WHERE place <= {TREE}""")
def merge_candidates(spark, sf_dir):
    """The partners that add least relational loss to the groups that have least."""
    f, _, domain, g = _groups(spark, sf_dir)
    g = materialize(g, "groups")
    centers = materialize(merge.lowest(g, "ncp", TOP), "centers")
    ids = {r["group_id"] for r in centers.select("group_id").collect()}
    found = nearest(g, centers, PairCost.make(f.schema, f.hierarchies, domain), TREE, id_column="group_id", measure="merge", exclude=ids)
    return found.select("center", "id", F.round("cost", 6).alias("cost"), "place")


@query(f""", {_GROUP_COST}
SELECT center, id, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY cost, id) AS place FROM (SELECT center, id, merged - g_ncp AS cost FROM pairs)) WHERE place = 1""")
def quick_merge_candidates(spark, sf_dir):
    f, _, domain, g = _groups(spark, sf_dir)
    g = materialize(g, "groups")
    centers = materialize(merge.lowest(g, "ncp", TOP), "centers")
    ids = {r["group_id"] for r in centers.select("group_id").collect()}
    found = nearest(g, centers, PairCost.make(f.schema, f.hierarchies, domain), 1, id_column="group_id", measure="quick", exclude=ids)
    return found.select("center", "id", F.round("cost", 6).alias("cost"))


@query("""SELECT group_id, CAST(dense_rank() OVER (ORDER BY round(ncp, 6)) + dense_rank() OVER (ORDER BY btd) AS BIGINT) AS rank_sum FROM grp_ncp JOIN (
  SELECT a.group_id, max((len(list_distinct(a.items || b.items)) - len(list_intersect(a.items, b.items)) + 1) * len(list_distinct(a.items || b.items)) / CAST(len(list_intersect(a.items, b.items)) + 1 AS DOUBLE)) AS btd
  FROM enc a JOIN enc b ON a.group_id = b.group_id AND a.row_id < b.row_id GROUP BY 1) USING (group_id)""")
def rank_sum_partners(spark, sf_dir):
    """Sum of two dense rankings, by relational loss and by item distance.

    A dense rank is a value's place among the distinct values, which are sorted
    by range and joined back.
    """
    _, _, _, g = _groups(spark, sf_dir)
    both = materialize(g.select("group_id", F.round("ncp", 6).alias("ncp")).join(btd_groups(spark, sf_dir), "group_id"), "ranked")
    for c in ("ncp", "btd"):
        both = dense_ranks(both, c, f"rank_{c}")
    return both.select("group_id", (F.col("rank_ncp") + F.col("rank_btd")).cast("long").alias("rank_sum"))


@query("""SELECT group_id, round(CASE WHEN d = 0 THEN 1e11 ELSE -n_rows / d END, 6) AS gain FROM (SELECT group_id, n_rows, round(ncp, 6) AS d FROM grp_ncp)""")
def merge_gain(spark, sf_dir):
    """The gain expression, with the number of rows as what is won."""
    _, _, _, g = _groups(spark, sf_dir)
    return g.select("group_id", F.round(gain(-F.col("n_rows"), F.round("ncp", 6)), 6).alias("gain"))


@query("""SELECT row_id, round(0.0 + a.leaf_frac + b.leaf_frac + c.leaf_frac + CASE WHEN hi > lo THEN (hi - lo) / (SELECT width FROM dom) ELSE 0.0 END, 6) AS ncp
FROM enc JOIN grp USING (group_id) JOIN frac a ON a.attr = 'nation' AND a.node = grp.nation JOIN frac b ON b.attr = 'priority' AND b.node = grp.priority JOIN frac c ON c.attr = 'status' AND c.node = grp.status""")
def row_loss(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    e = f.encoded
    g = generalize(e, f.schema, f.hierarchies)
    return g.select("row_id", F.round(row_ncp(f.schema, f.hierarchies, domains(e, f.schema)), 6).alias("ncp"))


# clustering, item anonymization and its loss --------------------------------------------------


@query(f""", ctr AS (SELECT * FROM enc ORDER BY row_id LIMIT {CENTERS}),
pairs AS (SELECT c.row_id AS center, e.row_id AS id, {_COST.format(a="e", b="c")} AS cost FROM enc e CROSS JOIN ctr c JOIN frac na ON na.attr = 'nation' AND na.node = e.nation JOIN frac nr ON nr.attr = 'nation' AND nr.node = e.region),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY cost, id) AS place FROM pairs) WHERE place <= {K + K // 2}),
ord AS (SELECT center, list(id ORDER BY place) AS ids, row_number() OVER (ORDER BY max(cost) FILTER (place = {K}), center) AS i FROM near GROUP BY center),
acc AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS center, CAST([] AS BIGINT[]) AS got
  UNION ALL
  SELECT i, CASE WHEN len(f) = {K} THEN used || f ELSE used END, center, CASE WHEN len(f) = {K} THEN f ELSE CAST([] AS BIGINT[]) END
  FROM (SELECT ord.i, acc.used, ord.center, list_filter(ord.ids, lambda x: NOT list_contains(acc.used, x))[1:{K}] AS f FROM acc JOIN ord ON ord.i = acc.i + 1)
)
SELECT unnest(got) AS row_id, center AS group_id FROM acc WHERE len(got) > 0""", recursive=True)
def cluster_round(spark, sf_dir):
    """One greedy round: the first centers, their nearest rows, and which centers are accepted."""
    f = fixture.load(spark, sf_dir)
    e = materialize(f.encoded, "encoded")
    joined = cluster.cluster_round(e, f.schema, PairCost.make(f.schema, f.hierarchies, domains(e, f.schema)), Params(k=K), CENTERS)
    return spark.createDataFrame(list(joined.items()), "row_id long, group_id long")


#: Cuts for sets of one item: an item that is too rare in its class goes to its noun, and all go to the root where that is too rare too.
_CUT = f"""it AS (SELECT e.row_id, e.status, e.priority, e.nation, e.item, l.parent AS noun FROM (SELECT row_id, status, priority, nation, unnest(items) AS item FROM enc) e JOIN links l ON l.attr = 'basket' AND l.child = e.item),
si AS (SELECT status, priority, nation, item, noun, count(DISTINCT row_id) AS n FROM it GROUP BY ALL),
sn AS (SELECT status, priority, nation, noun, count(DISTINCT row_id) AS n FROM it GROUP BY ALL),
low AS (SELECT status, priority, nation, bool_or(n < {K}) AS root FROM sn GROUP BY ALL),
lift AS (SELECT status, priority, nation, noun, bool_or(n < {K}) AS up FROM si GROUP BY ALL),
cut AS (SELECT DISTINCT it.row_id, status, priority, nation, CASE WHEN root THEN 0 WHEN up THEN noun ELSE item END AS node FROM it JOIN low USING (status, priority, nation) JOIN lift USING (status, priority, nation, noun))"""


def _cut(spark, sf_dir):
    f, e = _classes(spark, sf_dir)
    return f, pipeline.anonymize_items(e, f.schema, f.hierarchies, Params(k=K, m=1))


@query(f", {_CUT} SELECT row_id, {_LIST.format('list_sort(list(node))')} AS items FROM cut GROUP BY row_id")
def apriori_single_items(spark, sf_dir):
    """Items generalized class by class so that every item has support k."""
    _, out = _cut(spark, sf_dir)
    return out.select("row_id", _text("items").alias("items"))


@query(f""", {_CUT} SELECT status, priority, nation, CAST(sum(w.w) AS VARCHAR) AS ul FROM cut JOIN leafs f ON f.attr = 'basket' AND f.node = cut.node JOIN (VALUES {_UL}) w(u, w) ON w.u = f.leaf_cnt GROUP BY status, priority, nation""")
def ul_after_apriori(spark, sf_dir):
    """Item loss of every class after its items were generalized."""
    f, out = _cut(spark, sf_dir)
    loss = items.ul_hierarchy(out, f.hierarchies["basket"], CLASS)
    return loss.select(F.col("c_status").alias("status"), F.col("c_priority").alias("priority"), F.col("c_nation").alias("nation"), F.col("ul").cast("string").alias("ul"))


@query(f""", {_CUT}, loss AS (SELECT sum(w.w) AS ul FROM cut JOIN leafs f ON f.attr = 'basket' AND f.node = cut.node JOIN (VALUES {_UL}) w(u, w) ON w.u = f.leaf_cnt)
SELECT CAST(ul AS VARCHAR) AS ul_total, CAST((SELECT count(*) FROM enc) AS BIGINT) AS n_rows FROM loss""")
def ul_total_after_apriori(spark, sf_dir):
    """The total item loss, as merging sums it: class by class, in whole numbers of any size."""
    f, e = _classes(spark, sf_dir)
    losses = merge.group_ul(e, f.hierarchies["basket"], Params(k=K, m=1))
    return spark.createDataFrame([(str(merge.exact_total(losses)), e.count())], "ul_total string, n_rows long")


@query("""SELECT row_id FROM rt WHERE CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) < 858993459""")
def sample_rows(spark, sf_dir):
    """The sampling operator: a fifth of the rows without replacement, chosen by a hash of their id, alike on every run."""
    return pipeline.hash_sample(fixture.rows(spark, sf_dir).select("row_id"), 0.2)


@query(f"""SELECT * FROM (SELECT concat_ws(',', CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END, nation, priority, status, array_to_string(list_sort(list_transform(labels, lambda x: replace(x, ' ', '_'))), ' ')) AS value FROM rt)""")
def text_round_trip(spark, sf_dir):
    """Rows written as text under a header, read back by it, encoded, decoded and formatted."""
    f = fixture.load(spark, sf_dir)
    plain = f.rows.select("price", "nation", "priority", "status", F.transform("basket", lambda x: F.translate(x, " ", "_")).alias("basket"))
    return pipeline.text_round_trip(plain, f.schema, f.hierarchies)


# iterative plans: no SQL; tests check their invariants ------------------------------------------


def _classes(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    name = (F.col("c_status") * 1_000_000 + F.col("c_priority") * 1000 + F.col("c_nation")).cast("long")
    return f, f.encoded.withColumn("group_id", name)


@query()
def cluster_assign(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    return cluster.cluster_blocks(f.encoded.drop("group_id"), f.schema, f.hierarchies, Params(k=10))


@query()
def cluster_assign_rounds(spark, sf_dir):
    f = fixture.load(spark, sf_dir)
    return cluster.cluster_rounds(f.encoded.drop("group_id"), f.schema, f.hierarchies, Params(k=K))


@query()
def apriori_anonymize(spark, sf_dir):
    f, e = _classes(spark, sf_dir)
    out = pipeline.anonymize_items(e, f.schema, f.hierarchies, Params(k=10, m=M))
    return out.select("row_id", "group_id", _text("items").alias("items"))


@query()
def apriori_anonymize_strict(spark, sf_dir):
    f, e = _classes(spark, sf_dir)
    out = pipeline.anonymize_items(e, f.schema, f.hierarchies, Params(k=10, m=M, mode="strict"))
    return out.select("row_id", "group_id", _text("items").alias("items"))


@query()
def pcta_anonymize(spark, sf_dir):
    f, e = _classes(spark, sf_dir)
    out = pipeline.anonymize_items(e, f.schema, f.hierarchies, Params(k=10, m=M, ul="pcta"))
    braces = F.array_sort(F.transform("item_sets", lambda s: F.concat(F.lit("{"), _text(s), F.lit("}"))))
    return out.select("row_id", "group_id", F.array_join(braces, "").alias("sets"))


@query()
def merge_quick(spark, sf_dir):
    f, e = _classes(spark, sf_dir)
    return merge.quick_merge(e, f.schema, f.hierarchies, Params(k=K, rd=0.6, max_merges=100), domains(e, f.schema)).select("row_id", "group_id")


@query()
def merge_gain_rounds(spark, sf_dir):
    f, e = _classes(spark, sf_dir)
    return merge.merge_rounds(e, f.schema, f.hierarchies, Params(k=10, rd=0.6, max_merges=50), domains(e, f.schema)).select("row_id", "group_id")


@query()
def pipeline_rt(spark, sf_dir):
    """Cluster, merge, generalize, anonymize items; a formatted row each."""
    f = fixture.load(spark, sf_dir)
    done = pipeline.anonymize(f.encoded.drop("group_id"), f.schema, f.hierarchies, Params(k=10, m=M, rd=0.3), merging="quick")
    return format_rows(decode(done.rows, f.schema, f.hierarchies), f.schema)


@query()
def ul_serial_scaling(spark, sf_dir):
    """Item loss of every class in the serial scaling, by cuts of the hierarchy."""
    f, out = _cut(spark, sf_dir)
    out = materialize(out, "cut")
    return items.ul_serial(out, f.hierarchies["basket"], out.count())


def _status_classes(spark, sf_dir):
    """Few groups, for the methods that merge one pair at a time: orders by status and region."""
    f = fixture.load(spark, sf_dir)
    h = f.hierarchies["nation"]
    region = F.element_at(F.lit([h.parent(i) or 0 for i in range(h.size)]), F.col("c_nation") + 1)
    return f, f.encoded.withColumn("group_id", (F.col("c_status") * 1000 + region).cast("long"))


def _serial_merge(order: str, bound: str):
    def run(spark, sf_dir):
        f, e = _status_classes(spark, sf_dir)
        e = materialize(e, "encoded")
        d = 3.5 if bound == "ncp" else 0.0
        merger = merge.SerialMerger(f.schema, f.hierarchies, domains(e, f.schema), Params(k=K, m=1), order, bound, d)
        return merger(e).select("row_id", "group_id")

    run.__name__ = f"merge_serial_{order.lower()}_{bound}"
    run.__doc__ = f"Serial merging: partners by {order}, bound by {bound}."
    return run


for _order, _bound in merge.VARIANTS:
    query()(_serial_merge(_order, _bound))


@query()
def rum_bound(spark, sf_dir):
    """Serial clustering, merging by item distance within a bound of relational loss, item anonymization. One task holds the relational columns of the whole table, and one all baskets as bits."""
    f = fixture.load(spark, sf_dir)
    return _bounded(f, pipeline.rum_bound, 3.5, "T")


@query()
def tum_bound(spark, sf_dir):
    """The same with a bound of item loss, and partners by the sum of both ranks."""
    f = fixture.load(spark, sf_dir)
    return _bounded(f, pipeline.tum_bound, 0.0, "RT")


def _bounded(f, bound, d, order):
    out = bound(f.encoded.drop("group_id"), f.schema, f.hierarchies, Params(k=K, m=1), d, order)
    return out.select("row_id", "group_id", _text("items").alias("items"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group generalization with its loss."""
    _, _, _, g = _groups(spark, sf_dir)
    return g.select("group_id", "n_rows", F.col("n_price_lo").alias("lo"), F.col("n_price_hi").alias("hi"), F.col("c_nation").alias("nation"), F.col("c_priority").alias("priority"), F.col("c_status").alias("status"), F.round("ncp", 6).alias("ncp"))
