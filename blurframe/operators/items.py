"""Operators on the set-valued column: supports, generalization of items, item loss.

Both anonymizers work on a class's distinct item sets with their counts, which
are pre-aggregated before any grouped function, and give back a small mapping
from items to what replaces them. The mapping is applied to the rows with
array functions, so no function ever holds the rows of a class.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..hierarchy import DECIMAL_LEAVES, Hierarchy
from ..scratch import ship

# supports -----------------------------------------------------------------------------


def extended(items: Column, hierarchy: Hierarchy) -> Column:
    """The items and all their ancestors, sorted, without repetition."""
    paths = F.lit([hierarchy.path(i) for i in range(hierarchy.size)])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda x: F.element_at(paths, x + 1)))))


def combinations_column(items: Column, size: int) -> Column:
    """All subsets of ``size`` of a sorted array, each sorted."""
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    if size == 2:
        return F.flatten(F.transform(items, lambda x: F.transform(F.filter(items, lambda y: y > x), lambda y: F.array(x, y))))
    smaller = combinations_column(items, size - 1)
    return F.flatten(F.transform(smaller, lambda s: F.transform(F.filter(items, lambda y: y > F.element_at(s, -1)), lambda y: F.concat(s, F.array(y)))))


def itemset_support(df: DataFrame, size: int, hierarchy: Hierarchy | None = None, keys: list[str] | None = None) -> DataFrame:
    """(*keys, itemset, support): in how many rows each set of ``size`` items occurs.

    With a hierarchy, ancestors count as items and sets that hold an item with
    an ancestor of its own are left out. Equal baskets are counted first, so
    only distinct ones are taken apart.
    """
    keys = keys or []
    baskets = df.groupBy(*keys, "items").agg(F.count(F.lit(1)).alias("n"))
    items = extended(F.col("items"), hierarchy) if hierarchy is not None else F.array_sort(F.array_distinct("items"))
    sets = baskets.select(*keys, "n", F.explode(combinations_column(items, size)).alias("itemset"))
    if hierarchy is not None and size > 1:
        pairs = [[j for j in range(hierarchy.size) if j != i and hierarchy.related(i, j)] for i in range(hierarchy.size)]
        kin = F.lit([p or [-1] for p in pairs])
        sets = sets.where(~F.exists("itemset", lambda x: F.arrays_overlap(F.element_at(kin, x + 1), F.col("itemset"))))
    return sets.groupBy(*keys, "itemset").agg(F.sum("n").alias("support"))


def item_histogram(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, node, n): in how many rows each node stands."""
    return df.select(*(keys or []), F.explode("items").alias("node")).groupBy(*(keys or []), "node").agg(F.count(F.lit(1)).alias("n"))


# hierarchy-based anonymization ----------------------------------------------------------


class HierarchyCut:
    """Finds, for one class, the nodes that replace items so that sets of up to m items have support k.

    Depth by depth, sets of unrelated nodes of the extended rows are counted.
    A set below k is lifted: its deepest node (the smallest id of equals) goes
    to its parent until the set's support reaches k or the root is reached.
    In reference mode a set that shrinks while it is lifted has no support, as
    only sets of the depth are counted; strict mode counts it anew.
    """

    def __init__(self, hierarchy: Hierarchy, k: int, m: int, mode: str = "reference"):
        self.h, self.k, self.m, self.strict = hierarchy, k, m, mode == "strict"
        self.up = [frozenset(hierarchy.path(i)) for i in range(hierarchy.size)]
        self.below = [frozenset(hierarchy.crawl_down(i)) for i in range(hierarchy.size)]

    def __call__(self, baskets: list[tuple[tuple[int, ...], int]]) -> dict[int, int]:
        """Where each item of the class goes, from its (items, count)."""
        goes = {x: x for items, _ in baskets for x in items}
        for depth in range(1, self.m + 1):
            rows: Counter = Counter()
            for items, n in baskets:
                rows[frozenset(y for x in items for y in self.up[goes[x]])] += n
            support = self._count(rows, depth)
            if not support:
                break
            for rule in self._rules(support, rows, depth):
                goes = {x: rule if y in self.below[rule] else y for x, y in goes.items()}
        return goes

    def _count(self, rows: Counter, depth: int) -> Counter:
        support: Counter = Counter()
        for nodes, n in rows.items():
            for s in combinations(sorted(nodes), depth):
                if all(a not in self.up[b] and b not in self.up[a] for a, b in combinations(s, 2)):
                    support[s] += n
        return support

    def _rules(self, support: Counter, rows: Counter, depth: int) -> list[int]:
        rules: list[int] = []
        gone: set[int] = set()
        for s in sorted(support):
            if support[s] < self.k and gone.isdisjoint(s):
                for r in self._lift(s, support, rows, depth):
                    rules.append(r)
                    gone |= self.below[r]
        return rules

    def _lift(self, s: tuple[int, ...], support: Counter, rows: Counter, depth: int) -> list[int]:
        todo = [(-self.h.depth(x), x) for x in s]
        heapq.heapify(todo)
        now, cuts = set(s), []
        while True:
            _, x = heapq.heappop(todo)
            parent = self.h.parent(x)
            if parent is None:
                return cuts or [x]
            heapq.heappush(todo, (-self.h.depth(parent), parent))
            now = (now - set(self.h.children(parent))) | {parent}
            cuts = [c for c in cuts if self.h.parent(c) != parent and c != parent] + [parent]
            key = tuple(sorted(now))
            if self.strict and len(key) < depth:
                reached = sum(n for nodes, n in rows.items() if now <= nodes)
            else:
                reached = support.get(key, 0)
            if reached >= self.k:
                return cuts


# set-based anonymization ----------------------------------------------------------------


class SetMerge:
    """Finds, for one class, sets of items that replace their members so that sets of up to m items have support k.

    Constraints (the subsets of min(m, size) items of the rows) are taken by
    ascending support. While one is below k, the set in it and the other set
    whose union loses least, (2^size - 1) times its support, are merged. Ties
    go to the smaller items.
    """

    def __init__(self, k: int, m: int):
        self.k, self.m = k, m

    def __call__(self, baskets: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[int, ...]]:
        baskets = [(items, n) for items, n in baskets if items]
        universe = sorted({x for items, _ in baskets for x in items})
        column = {x: i for i, x in enumerate(universe)}
        seen = np.zeros((len(universe), len(baskets)), dtype=bool)
        weight = np.array([n for _, n in baskets], dtype=np.int64)
        for r, (items, _) in enumerate(baskets):
            seen[[column[x] for x in items], r] = True
        hits = {(x,): seen[i] for x, i in column.items()}  # rows that hold some item of a set
        of = {x: (x,) for x in universe}
        wanted = {c for items, _ in baskets for c in combinations(sorted(items), min(self.m, len(items)))}

        def support(sets) -> int:
            rows = np.ones(len(baskets), dtype=bool)
            for s in sets:
                rows &= hits[s]
            return int(weight[rows].sum())

        for constraint in sorted(wanted, key=lambda c: (support([(x,) for x in c]), c)):
            now = list(dict.fromkeys(of[x] for x in constraint))
            reached = support(now)
            while 0 < reached < self.k:
                best = None
                others = sorted(set(of.values()))
                table = np.array([hits[o] for o in others])
                for s in now:
                    sums = (table | hits[s]) @ weight
                    for o, n in zip(others, sums):
                        if o != s:
                            cost = ((1 << (len(s) + len(o))) - 1) * int(n)
                            if best is None or cost < best[0]:
                                best = (cost, s, o)
                if best is None:
                    break
                _, s, o = best
                union = tuple(sorted(s + o))
                hits[union] = hits[s] | hits[o]
                for x in union:
                    of[x] = union
                now = [u for u in now if u not in (s, o)] + [union]
                reached = support(now)
        return of


def _distinct_baskets(df: DataFrame) -> DataFrame:
    return df.groupBy("group_id", "items").agg(F.count(F.lit(1)).alias("n"))


def _rows(pdf: pd.DataFrame) -> list[tuple[tuple[int, ...], int]]:
    return sorted((tuple(int(x) for x in items), int(n)) for items, n in zip(pdf["items"], pdf["n"]))


def hierarchy_mapping(df: DataFrame, hierarchy: Hierarchy, k: int, m: int, mode: str = "reference") -> DataFrame:
    """(group_id, mapping): for each class, a map from its items to the nodes that replace them."""
    ship(df.sparkSession)
    cut = HierarchyCut(hierarchy, k, m, mode)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        goes = cut(_rows(pdf))
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "item": [list(goes)], "node": [list(goes.values())]})

    out = _distinct_baskets(df).groupBy("group_id").applyInPandas(run, "group_id long, item array<int>, node array<int>")
    return out.select("group_id", F.map_from_arrays("item", "node").alias("mapping"))


def set_mapping(df: DataFrame, k: int, m: int) -> DataFrame:
    """(group_id, mapping): for each class, a map from its items to the sets that replace them."""
    ship(df.sparkSession)
    merge = SetMerge(k, m)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = merge(_rows(pdf))
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "item": [list(of)], "sets": [[list(s) for s in of.values()]]})

    out = _distinct_baskets(df).groupBy("group_id").applyInPandas(run, "group_id long, item array<int>, sets array<array<int>>")
    return out.select("group_id", F.map_from_arrays("item", "sets").alias("mapping"))


def apply_node_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items replaced by nodes, sorted, without repetition."""
    new = F.transform("items", lambda x: F.element_at("mapping", x))
    return df.join(mapping, "group_id").withColumn("items", F.array_sort(F.array_distinct(new))).drop("mapping")


def apply_set_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``item_sets`` in place of the items, which are emptied."""
    new = F.transform("items", lambda x: F.element_at("mapping", x))
    out = df.join(mapping, "group_id").withColumn("item_sets", F.array_sort(F.array_distinct(new)))
    return out.withColumn("items", F.array().cast("array<int>")).drop("mapping")


def apply_rules(items: Column, rules: list[tuple[list[int], int]]) -> Column:
    """Rules in order: where an item of the rule's left side stands, all of them go and the right side comes."""
    for requires, result in rules:
        some = F.lit([int(x) for x in requires])
        items = F.when(F.arrays_overlap(items, some), F.array_union(F.array_except(items, some), F.array(F.lit(result)))).otherwise(items)
    return F.array_sort(items)


# loss -----------------------------------------------------------------------------------


def _weights(hierarchy: Hierarchy) -> Column:
    return F.lit([str(hierarchy.ul_weight(i)) for i in range(hierarchy.size)])


def ul_hierarchy(df: DataFrame, hierarchy: Hierarchy, keys: list[str] | None = None) -> DataFrame:
    """(*keys, ul): the sum over nodes of their occurrences times 2^u - 1, exactly.

    Nodes are counted before they are weighed. Up to ``DECIMAL_LEAVES`` leaves
    the sum is a decimal; beyond, use :func:`ul_histogram`.
    """
    if hierarchy.n_leaves > DECIMAL_LEAVES:
        raise ValueError(f"over {DECIMAL_LEAVES} leaves: finish ul_histogram with exact_ul")
    keys = keys or []
    some = df.withColumn("items", F.when(F.size("items") > 0, F.col("items")).otherwise(F.array(F.lit(-1))))
    counted = item_histogram(some, keys)
    value = F.when(F.col("node") >= 0, F.element_at(_weights(hierarchy), F.greatest(F.col("node"), F.lit(0)) + 1).cast("decimal(38,0)") * F.col("n").cast("decimal(18,0)")).otherwise(F.lit(0))
    return counted.select(*keys, value.cast("decimal(38,0)").alias("ul")).groupBy(*keys).agg(F.sum("ul").cast("decimal(38,0)").alias("ul"))


def ul_histogram(df: DataFrame, hierarchy: Hierarchy, keys: list[str] | None = None) -> DataFrame:
    """(*keys, leaves, n): occurrences by number of leaves, for hierarchies whose weights no decimal holds."""
    keys = keys or []
    leaves = F.element_at(F.lit(hierarchy.leaf_counts), F.col("node") + 1)
    return item_histogram(df, keys).withColumn("leaves", leaves).groupBy(*keys, "leaves").agg(F.sum("n").alias("n"))


def exact_ul(histogram: list[tuple[int, int]]) -> int:
    """The loss of (leaves, occurrences) pairs, in whole numbers of any size."""
    return sum(n * (2**u - 1) for u, n in histogram)


def ul_sets(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, ul): the sum over the rows' sets of more than one item of 2^size - 1, exactly up to 100 items a set."""
    keys = keys or []
    powers = F.lit(["0", "0", *[str(2**i - 1) for i in range(2, 101)]])
    sets = df.select(*keys, F.explode_outer("item_sets").alias("s"))
    size = F.coalesce(F.greatest(F.size("s"), F.lit(0)), F.lit(0))
    counted = sets.groupBy(*keys, size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    value = F.element_at(powers, F.col("size") + 1).cast("decimal(38,0)") * F.col("n").cast("decimal(18,0)")
    return counted.select(*keys, value.cast("decimal(38,0)").alias("ul")).groupBy(*keys).agg(F.sum("ul").cast("decimal(38,0)").alias("ul"))


def ul_serial(anonymized: DataFrame, hierarchy: Hierarchy, n_rows: int) -> DataFrame:
    """(group_id, ul): item loss in the serial scaling, as decimal text.

    Each row's loss is divided by the largest possible one, rounded up to 100
    places (200 for sets), and a group's sum by the number of rows of the table,
    rounded up to 200 places.
    """
    ship(anonymized.sparkSession)
    sets = "item_sets" in anonymized.columns
    most, places = 2**hierarchy.n_leaves - 1, 200 if sets else 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from decimal import ROUND_UP, Decimal, localcontext

        with localcontext() as ctx:
            ctx.prec = 300 + len(str(most))
            total = Decimal(0)
            for row, n in zip(pdf["row"], pdf["n"]):
                loss = sum(2 ** len(s) - 1 for s in row if len(s) > 1) if sets else sum(hierarchy.ul_weight(int(x)) for x in row)
                total += int(n) * (Decimal(loss) / most).quantize(Decimal(1).scaleb(-places), rounding=ROUND_UP)
            share = (total / n_rows).quantize(Decimal(1).scaleb(-200), rounding=ROUND_UP)
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "ul": [format(share, "f")]})

    rows = anonymized.select("group_id", F.col("item_sets" if sets else "items").alias("row"))
    return rows.groupBy("group_id", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").applyInPandas(run, "group_id long, ul string")


def ul_readable(total: int, item_leaves: int, n_rows: int):
    """Total item loss as a share of the largest possible, to five places, rounded up."""
    from decimal import ROUND_CEILING, Decimal, localcontext

    with localcontext() as ctx:
        ctx.prec = max(50, item_leaves)
        return (Decimal(total) / (Decimal(2**item_leaves - 1) * n_rows)).quantize(Decimal("0.00001"), rounding=ROUND_CEILING)
