"""Text datasets with a declared header, hierarchy and domain files, and the text sink.

Files are read through Spark's readers, so any file system that Spark opens
will do. Only metadata (a header line, a hierarchy, a domain) comes to the
driver; rows never do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hierarchy import Hierarchy
from ..operators.encode import Hierarchies, check_domains, encode
from ..operators.generalize import relational_columns
from ..schema import RTSchema, SchemaError


def read_header(spark: SparkSession, path: str) -> str:
    """The first line of a dataset."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise SchemaError(f"{path} is empty")
    return first["value"]


def read_hierarchy(spark: SparkSession, path: str, name: str) -> Hierarchy:
    """A hierarchy file: ``parent:child1,child2,...`` per line."""
    return Hierarchy.from_lines((r["value"] for r in spark.read.text(path).collect()), name)


def read_domain(spark: SparkSession, path: str) -> tuple[float, float]:
    """A numeric domain file: one line ``min-max``; either number may have a sign and a fraction."""
    line = read_header(spark, path).strip()
    m = re.fullmatch(r"(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)", line)
    if not m or float(m[1]) > float(m[2]):
        raise SchemaError(f"domain {line!r} is not min-max")
    return float(m[1]), float(m[2])


def read_metadata(spark: SparkSession, folder: str, schema: RTSchema) -> tuple[Hierarchies, dict[str, tuple[float, float]]]:
    """Hierarchies and declared domains, from the file of each column's name in ``folder``."""
    hierarchies = {n: read_hierarchy(spark, f"{folder}/{n}", n) for n in [*schema.categorical, schema.items]}
    return hierarchies, {n: read_domain(spark, f"{folder}/{n}") for n in schema.numeric}


def parse(lines: DataFrame, schema: RTSchema, splitter: str = ",") -> DataFrame:
    """Columns of a dataset's lines(value[, row_id]): doubles, strings, and an array of items without blanks.

    ``splitter`` is a regular expression. A field that is missing at the end of
    a line is a null, or an empty set of items.
    """
    parts = F.split("value", splitter)
    cols = [F.col("row_id")] if "row_id" in lines.columns else []
    for i, (name, kind) in enumerate(schema.columns):
        field = F.get(parts, F.lit(i))
        if kind == "n":
            cols.append(F.trim(field).cast("double").alias(name))
        elif kind == "c":
            cols.append(F.trim(field).alias(name))
        else:
            items = F.filter(F.split(F.trim(F.coalesce(field, F.lit(""))), r"\s+"), lambda x: x != "")
            cols.append(F.array_distinct(items).alias(name))
    return lines.select(*cols)


def row_ids(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds a unique ``row_id``: from ``keys`` (a natural key) if given, else by partition and place.

    Ids by partition and place hold as long as the files and their splits do;
    write the table once, or pass a key, where they must survive longer.
    """
    if keys:
        return lines.withColumn("row_id", F.xxhash64(*keys))
    return lines.withColumn("row_id", F.monotonically_increasing_id())


def read_dataset(spark: SparkSession, path: str, splitter: str = ",", schema: RTSchema | None = None) -> tuple[RTSchema, DataFrame]:
    """(schema, rows with row_id) of a text dataset; without ``schema`` the first line declares it.

    Lines equal to the header are left out wherever they stand.
    """
    lines = spark.read.text(path)
    if schema is None:
        header = read_header(spark, path)
        schema = RTSchema.from_header(header)
        lines = lines.where(F.col("value") != header)
    return schema, parse(row_ids(lines.where(F.trim("value") != "")), schema, splitter)


def read_encoded(spark: SparkSession, path: str, folder: str, splitter: str = ",", schema: RTSchema | None = None):
    """(schema, hierarchies, domains, encoded rows): a dataset with its metadata; values outside them are errors."""
    schema, rows = read_dataset(spark, path, splitter, schema)
    hierarchies, declared = read_metadata(spark, folder, schema)
    encoded = encode(rows, schema, hierarchies)
    check_domains(encoded, declared)
    return schema, hierarchies, declared, encoded


def format_rows(decoded: DataFrame, schema: RTSchema) -> DataFrame:
    """(value): one line per decoded row; items are joined by spaces, item sets stand in braces."""
    fields: list[Column] = []
    for name, kind in schema.columns:
        if kind != "t":
            fields.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        elif decoded.schema[name].dataType.elementType.typeName() == "array":
            fields.append(F.array_join(F.transform(name, lambda s: F.concat(F.lit("{"), F.array_join(s, " "), F.lit("}"))), ""))
        else:
            fields.append(F.array_join(name, " "))
    return decoded.select(F.concat_ws(",", *fields).alias("value"))


def write_text(decoded: DataFrame, schema: RTSchema, path: str) -> None:
    """Write decoded rows as text, one line per row."""
    format_rows(decoded, schema).write.mode("overwrite").text(path)


def distinct_relational(encoded: DataFrame, schema: RTSchema) -> DataFrame:
    """The relational key of every row, items left out."""
    return encoded.select("row_id", *relational_columns(schema))
