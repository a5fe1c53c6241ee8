"""Between values and node ids.

An encoded table has ``row_id``, ``n_<name>_lo`` and ``n_<name>_hi`` for each
numeric column, ``c_<name>`` for each categorical one, and ``items``, a sorted
array of ids without repetition. Dictionaries are the hierarchies' node tables,
which are small dimensions; joins with them are broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..hierarchy import Hierarchy
from ..schema import RTSchema, SchemaError
from ..scratch import BROADCAST_ROWS

Hierarchies = dict[str, Hierarchy]


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, id) of a column's distinct values; ids go by value, so they do not depend on row order."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    ids = {r["value"]: i for i, r in enumerate(values.orderBy("value").limit(BROADCAST_ROWS + 1).collect())}
    if len(ids) > BROADCAST_ROWS:
        raise SchemaError(f"{column!r} has over {BROADCAST_ROWS} values; categorical columns need a smaller domain")
    return df.sparkSession.createDataFrame(list(ids.items()), f"value {values.schema['value'].dataType.simpleString()}, id int")


def lookup(hierarchy: Hierarchy, value: Column) -> Column:
    """The node id of a label; null if the hierarchy lacks it."""
    return F.element_at(_map(hierarchy.ids), value)


def reverse(hierarchy: Hierarchy, node: Column) -> Column:
    """The label of a node id."""
    return F.element_at(_array(hierarchy.labels), node + 1)


def _map(ids: dict[str, int]) -> Column:
    return F.map_from_arrays(F.lit(list(ids)), F.lit([int(i) for i in ids.values()]))


def _array(values: list) -> Column:
    return F.lit(list(values))


def missing_values(df: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """(attr, value, n) of the values that no hierarchy has; nulls of categorical columns are reported as well."""
    parts = []
    for c in schema.categorical:
        parts.append(df.select(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")))
    parts.append(df.select(F.lit(schema.items).alias("attr"), F.explode(F.col(schema.items)).alias("value")).where("trim(value) <> ''"))
    out = None
    for name, part in zip([*schema.categorical, schema.items], parts):
        bad = part.where(lookup(hierarchies[name], F.col("value")).isNull()).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
        out = bad if out is None else out.unionByName(bad)
    return out


def encode(df: DataFrame, schema: RTSchema, hierarchies: Hierarchies, row_id: str = "row_id", validate: bool = True) -> DataFrame:
    """The encoded table of ``df``, whose set-valued column is an array of labels (null: empty).

    Values that a hierarchy lacks are an error, reported with examples.
    """
    if validate:
        bad = missing_values(df, schema, hierarchies).orderBy("attr", "value").limit(5).collect()
        if bad:
            raise SchemaError("values missing from hierarchies: " + ", ".join(f"{r['attr']}={r['value']!r} ({r['n']})" for r in bad))
    cols = [F.col(row_id).cast("long").alias("row_id")]
    for n in schema.numeric:
        cols += [F.col(n).cast("double").alias(f"n_{n}_lo"), F.col(n).cast("double").alias(f"n_{n}_hi")]
    for c in schema.categorical:
        cols.append(lookup(hierarchies[c], F.col(c).cast("string")).alias(f"c_{c}"))
    h = hierarchies[schema.items]
    items = F.filter(F.coalesce(F.col(schema.items), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    cols.append(F.array_sort(F.array_distinct(F.transform(items, lambda x: lookup(h, x)))).alias("items"))
    return df.select(*cols, *([F.col("group_id")] if "group_id" in df.columns else []))


def decode(df: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """Labels for ids: numeric columns as text, categorical ones as labels, items as an array of labels."""
    from ..functions import interval_text

    cols = [c for c in ("row_id", "group_id") if c in df.columns]
    for name, kind in schema.columns:
        if kind == "n":
            cols.append(interval_text(F.col(f"n_{name}_lo"), F.col(f"n_{name}_hi")).alias(name))
        elif kind == "c":
            cols.append(reverse(hierarchies[name], F.col(f"c_{name}")).alias(name))
        else:
            h = hierarchies[name]
            if "item_sets" in df.columns:
                sets = F.transform("item_sets", lambda s: F.array_sort(F.transform(s, lambda x: reverse(h, x))))
                cols.append(F.array_sort(sets).alias(name))
            else:
                cols.append(F.array_sort(F.transform("items", lambda x: reverse(h, x))).alias(name))
    return df.select(*cols)


def with_levels(df: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """Adds ``c_<name>_l0`` ... for each categorical column: the ids from the root down to its node."""
    cols = {}
    for c in schema.categorical:
        h = hierarchies[c]
        levels = [h.levels(i) for i in range(h.size)]
        for i in range(h.height + 1):
            cols[f"c_{c}_l{i}"] = F.element_at(_array([row[i] for row in levels]), F.col(f"c_{c}") + 1)
    return df.withColumns(cols) if cols else df


def domains(encoded: DataFrame, schema: RTSchema, declared: dict[str, tuple[float, float]] | None = None) -> dict[str, float]:
    """Width of each numeric column's domain: as declared, else as observed in the rows (one job for all)."""
    declared = declared or {}
    own = [n for n in schema.numeric if n not in declared]
    out = {n: float(hi - lo) for n, (lo, hi) in declared.items()}
    if own:
        row = encoded.agg(*[F.min(f"n_{n}_lo").alias(f"lo_{n}") for n in own], *[F.max(f"n_{n}_hi").alias(f"hi_{n}") for n in own]).first()
        out.update({n: float(row[f"hi_{n}"] - row[f"lo_{n}"]) if row[f"lo_{n}"] is not None else 0.0 for n in own})
    return out


def check_domains(encoded: DataFrame, declared: dict[str, tuple[float, float]]) -> None:
    """Raise if a value lies outside its declared domain."""
    tests = [F.sum(((F.col(f"n_{n}_lo") < lo) | (F.col(f"n_{n}_hi") > hi)).cast("long")).alias(n) for n, (lo, hi) in declared.items()]
    if tests:
        bad = {n: v for n, v in encoded.agg(*tests).first().asDict().items() if v}
        if bad:
            raise SchemaError(f"values outside the declared domain: {bad}")
