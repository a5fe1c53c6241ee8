"""Independent checks of an anonymized table. Each gives the rows that break a rule; none should be left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..hierarchy import Hierarchy
from ..schema import RTSchema
from .encode import Hierarchies
from .generalize import relational_columns
from .items import itemset_support


def class_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_rows) of the classes of equal relational values."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def k_violations(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Classes with fewer than ``k`` rows."""
    return class_sizes(df, keys).where(F.col("n_rows") < k)


def km_violations(df: DataFrame, keys: list[str], k: int, m: int) -> DataFrame:
    """(*keys, itemset, support) of every set of up to ``m`` items that occurs in fewer than ``k`` rows of its class.

    ``hopeless`` marks classes with fewer than ``k`` rows that have items at
    all, where no generalization can reach ``k``.
    """
    filled = df.where(F.size("items") > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("filled"))
    out = None
    for size in range(1, m + 1):
        one = itemset_support(df, size, keys=keys).where(F.col("support") < k)
        out = one if out is None else out.unionByName(one)
    return out.join(filled, keys).withColumn("hopeless", F.col("filled") < k).drop("filled")


def set_km_violations(df: DataFrame, keys: list[str], k: int, m: int) -> DataFrame:
    """As :func:`km_violations`, for rows of item sets."""
    numbered = df.select(*keys, F.transform("item_sets", lambda s: F.array_join(s, " ")).alias("items"))
    return km_violations(numbered, keys, k, m)


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """row_id of rows that only one of the tables has, or that one has twice."""
    a = before.groupBy("row_id").agg(F.count(F.lit(1)).alias("a"))
    b = after.groupBy("row_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "row_id", "full").where("NOT (a <=> 1 AND b <=> 1)").select("row_id")


def not_covered(before: DataFrame, after: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """row_id of rows whose generalized values do not cover their own: outside the interval, or not an ancestor."""
    a = before.select("row_id", *[F.col(c).alias(f"a_{c}") for c in relational_columns(schema)])
    joined = a.join(after.select("row_id", *relational_columns(schema)), "row_id")
    bad = F.lit(False)
    for n in schema.numeric:
        bad = bad | (F.col(f"a_n_{n}_lo") < F.col(f"n_{n}_lo")) | (F.col(f"a_n_{n}_hi") > F.col(f"n_{n}_hi"))
    for c in schema.categorical:
        h = hierarchies[c]
        paths = F.lit([h.path(i) for i in range(h.size)])
        bad = bad | ~F.array_contains(F.element_at(paths, F.col(f"a_c_{c}") + 1), F.col(f"c_{c}"))
    return joined.where(bad).select("row_id")


def items_not_covered(before: DataFrame, after: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """row_id of rows where some item has no ancestor among the new items, or a new item stands for none."""
    paths = F.lit([hierarchy.path(i) for i in range(hierarchy.size)])
    joined = before.select("row_id", F.col("items").alias("own")).join(after.select("row_id", "items"), "row_id")
    missing = F.exists("own", lambda x: ~F.arrays_overlap(F.element_at(paths, x + 1), F.col("items")))
    idle = F.exists("items", lambda y: ~F.exists("own", lambda x: F.array_contains(F.element_at(paths, x + 1), y)))
    return joined.where(missing | idle).select("row_id")
