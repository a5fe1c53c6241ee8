"""Group generalization: interval hulls and lowest common ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interval_share, lca_of_levels, level_min_max
from ..schema import RTSchema
from .encode import Hierarchies, with_levels


def relational_columns(schema: RTSchema) -> list[str]:
    """The encoded relational columns, in schema order."""
    out = []
    for name, kind in schema.columns:
        if kind == "n":
            out += [f"n_{name}_lo", f"n_{name}_hi"]
        elif kind == "c":
            out.append(f"c_{name}")
    return out


def group_table(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """One row per ``group_id``: n_rows, the hull of each numeric and the lowest common ancestor of each categorical column.

    One aggregation with partial sums; integer levels keep it hash-based.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for n in schema.numeric:
        aggs += [F.min(f"n_{n}_lo").alias(f"n_{n}_lo"), F.max(f"n_{n}_hi").alias(f"n_{n}_hi")]
    for c in schema.categorical:
        aggs += level_min_max(f"c_{c}_", hierarchies[c].height)
    grouped = with_levels(encoded, schema, hierarchies).groupBy("group_id").agg(*aggs)
    cols = ["group_id", "n_rows"]
    for n in schema.numeric:
        cols += [F.col(f"n_{n}_lo"), F.col(f"n_{n}_hi")]
    for c in schema.categorical:
        cols.append(lca_of_levels(f"c_{c}_", hierarchies[c].height).alias(f"c_{c}"))
    return grouped.select(*cols)


def merge_groups(groups: DataFrame, mapping: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """The group table after relabelling by ``mapping(group_id, new_id)``; groups that it lacks stay."""
    relabelled = groups.join(mapping, "group_id", "left").withColumn("group_id", F.coalesce("new_id", "group_id")).drop("new_id")
    aggs = [F.sum("n_rows").alias("n_rows")]
    for n in schema.numeric:
        aggs += [F.min(f"n_{n}_lo").alias(f"n_{n}_lo"), F.max(f"n_{n}_hi").alias(f"n_{n}_hi")]
    for c in schema.categorical:
        aggs += level_min_max(f"c_{c}_", hierarchies[c].height)
    merged = with_levels(relabelled, schema, hierarchies).groupBy("group_id").agg(*aggs)
    cols = ["group_id", "n_rows"]
    for n in schema.numeric:
        cols += [F.col(f"n_{n}_lo"), F.col(f"n_{n}_hi")]
    for c in schema.categorical:
        cols.append(lca_of_levels(f"c_{c}_", hierarchies[c].height).alias(f"c_{c}"))
    return merged.select(*cols)


def generalize(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, groups: DataFrame | None = None) -> DataFrame:
    """Every row with its group's relational values; its items stay its own."""
    groups = group_table(encoded, schema, hierarchies) if groups is None else groups
    own = [c for c in encoded.columns if c not in relational_columns(schema)]
    return encoded.select(*own).join(groups.select("group_id", *relational_columns(schema)), "group_id")


def coalesce_classes(generalized: DataFrame, schema: RTSchema) -> DataFrame:
    """Rows with equal generalized relational values become one class, named by its smallest group_id."""
    keys = relational_columns(schema)
    names = generalized.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("group_id").alias("_class"))
    joined = generalized.join(names, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.withColumn("group_id", F.col("_class")).select(*generalized.columns)


def row_ncp(schema: RTSchema, hierarchies: Hierarchies, domain: dict[str, float], serial: bool = False) -> Column:
    """Normalized certainty penalty of a row's or group's relational values.

    A categorical value costs its share of the leaves (a leaf costs nothing)
    and an interval its share of the domain. ``serial`` weighs the columns and
    counts a node only from two leaves on.
    """
    out = F.lit(0.0)
    for c in schema.categorical:
        h = hierarchies[c]
        costs = [0.0 if serial and h.leaf_counts[i] < 2 else h.leaf_frac(i) for i in range(h.size)]
        term = F.element_at(F.lit(costs), F.col(f"c_{c}") + 1)
        out = out + (term * schema.weight(c) if serial else term)
    for n in schema.numeric:
        term = interval_share(F.col(f"n_{n}_lo"), F.col(f"n_{n}_hi"), domain[n])
        out = out + (term * schema.weight(n) if serial else term)
    return out


def group_ncp(groups: DataFrame, schema: RTSchema, hierarchies: Hierarchies, domain: dict[str, float], serial_rows: int | None = None) -> DataFrame:
    """Adds ``ncp``, a group's row loss times its rows; with ``serial_rows`` the weighted loss over that many rows."""
    one = row_ncp(schema, hierarchies, domain, serial=serial_rows is not None)
    whole = one * F.col("n_rows")
    return groups.withColumn("ncp", whole / F.lit(float(serial_rows)) if serial_rows else whole)


def dataset_ncp(groups_with_ncp: DataFrame, schema: RTSchema) -> DataFrame:
    """One row: n_rows, n_groups, total ncp, and ncp per row and attribute (which lies in [0, 1])."""
    total = groups_with_ncp.agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.sum("ncp").alias("ncp"))
    return total.withColumn("ncp_readable", F.col("ncp") / F.col("n_rows") / F.lit(float(schema.n_relational)))
