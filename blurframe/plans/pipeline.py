"""Anonymization from end to end."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, items, merge
from ..operators.encode import Hierarchies, decode, domains, encode
from ..operators.generalize import coalesce_classes, dataset_ncp, generalize, group_ncp, group_table
from ..operators.neighbors import PairCost
from ..schema import Params, RTSchema, SchemaError
from ..scratch import materialize, scratch_path
from ..sources import text


@dataclass
class Result:
    """An anonymized table (encoded) with its losses: ``ncp`` and ``ul`` as shares of the largest possible."""

    rows: DataFrame
    n_rows: int
    n_groups: int
    ncp: float
    ul_total: int
    ul: float


def anonymize_items(grouped: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params) -> DataFrame:
    """Items generalized class by class, by cuts of the hierarchy or by sets."""
    if params.ul == "hierarchy":
        mapping = items.hierarchy_mapping(grouped, hierarchies[schema.items], params.k, params.m, params.mode)
        return items.apply_node_mapping(grouped, mapping)
    return items.apply_set_mapping(grouped, items.set_mapping(grouped, params.k, params.m))


def item_loss(anonymized: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params) -> int:
    """Total item loss of an anonymized table."""
    h = hierarchies[schema.items]
    if params.ul == "pcta":
        return int(items.ul_sets(anonymized).first()["ul"] or 0)
    if h.n_leaves <= 100:
        return int((items.ul_hierarchy(anonymized, h).first() or {"ul": 0})["ul"] or 0)
    return items.exact_ul([(r["leaves"], r["n"]) for r in items.ul_histogram(anonymized, h).collect()])


def assign(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, domain: dict[str, float], how: str = "blocks") -> DataFrame:
    """``encoded`` with a ``group_id`` of at least k rows each."""
    make = {"blocks": cluster.cluster_blocks, "rounds": cluster.cluster_rounds}.get(how)
    if make is None:
        raise SchemaError("how is 'blocks' or 'rounds'")
    names = make(encoded, schema, hierarchies, params, domain)
    return encoded.drop("group_id").join(names, "row_id")


def anonymize(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, how: str = "blocks", merging: str | None = "quick", declared: dict[str, tuple[float, float]] | None = None, sample: tuple[float, int] | None = None, max_rounds: int | None = None) -> Result:
    """Cluster, merge, generalize, and anonymize items.

    ``merging`` is None, ``quick`` (by relational loss) or ``gain`` (by item
    loss gained). ``sample`` is (fraction, seed) of a sample without
    replacement, drawn before rows are counted.
    """
    if sample is not None:
        encoded = encoded.sample(False, *sample)
    encoded = materialize(encoded, "encoded")
    domain = domains(encoded, schema, declared)
    grouped = materialize(assign(encoded, schema, hierarchies, params, domain, how), "grouped")
    if merging == "quick":
        grouped = merge.quick_merge(grouped, schema, hierarchies, params, domain, max_rounds=max_rounds)
    elif merging == "gain":
        grouped = merge.merge_rounds(grouped, schema, hierarchies, params, domain, max_rounds=max_rounds)
    elif merging is not None:
        raise SchemaError("merging is None, 'quick' or 'gain'")
    classes = coalesce_classes(generalize(grouped, schema, hierarchies), schema)
    classes = materialize(classes, "classes")
    out = materialize(anonymize_items(classes, schema, hierarchies, params), "anonymized")
    groups = group_ncp(group_table(out, schema, hierarchies), schema, hierarchies, domain)
    total = dataset_ncp(groups, schema).first()
    ul = item_loss(out, schema, hierarchies, params)
    n = int(total["n_rows"] or 0)
    share = float(items.ul_readable(ul, hierarchies[schema.items].n_leaves, n)) if n else 0.0
    return Result(out, n, int(total["n_groups"]), float(total["ncp_readable"] or 0.0), ul, share)


def hash_sample(rows: DataFrame, fraction: float, key: str = "row_id") -> DataFrame:
    """A sample without replacement by a hash of ``key``: the same rows on every run, however they are dealt out."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.where(place < int(fraction * (1 << 32)))


def text_round_trip(rows: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """``rows`` written as text with a header and hierarchy files, read back, encoded, decoded and formatted: (value).

    Blanks in item labels become underscores, as items are separated by blanks.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, "text")
    write = lambda lines, name: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/{name}")
    write([",".join(f"{n}#{k}" for n, k in schema.columns)], "header")
    text.write_text(rows, schema, f"{folder}/rows")
    for name, h in hierarchies.items():
        label = [x.replace(" ", "_") if name == schema.items else x for x in h.labels]
        write([f"{label[i]}:{','.join(label[c] for c in h.children(i))}" for i in range(h.size) if h.children(i)], f"meta/{name}")
    read_schema = RTSchema.from_header(text.read_header(spark, f"{folder}/header"))
    _, back = text.read_dataset(spark, f"{folder}/rows", schema=read_schema)
    read = {n: text.read_hierarchy(spark, f"{folder}/meta/{n}", n) for n in hierarchies}
    return text.format_rows(decode(encode(back, read_schema, read), read_schema, read), read_schema)


class BoundMissed(ValueError):
    """A loss bound that the clustering alone already misses."""


def rum_bound(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, d: float, order: str | None = "R") -> DataFrame:
    """Cluster serially, in one task, check the relational loss per row against ``d``, merge within it (``order`` of partners; None: not at all), anonymize items."""
    return _bounded(encoded, schema, hierarchies, params, d, order, "ncp")


def tum_bound(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, d: float, order: str | None = "R") -> DataFrame:
    """Cluster serially, in one task, merge until the item loss is within ``d`` (a share; ``order`` None: not at all), anonymize items."""
    return _bounded(encoded, schema, hierarchies, params, d, order, "ul")


def _bounded(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, d: float, order: str | None, bound: str) -> DataFrame:
    domain = domains(encoded, schema)
    names = cluster.serial_groups(encoded, schema, hierarchies, params, domain)
    grouped = _extend(materialize(encoded.drop("group_id").join(names, "row_id"), "grouped"), schema, hierarchies)
    if bound == "ncp":
        n = grouped.count()
        loss = group_ncp(group_table(grouped, schema, hierarchies), schema, hierarchies, domain, serial_rows=n).agg(F.sum("ncp")).first()[0]
        if loss > d:
            raise BoundMissed(f"clustering alone loses {loss:.4f}, over {d}")
    if order is not None:
        grouped = merge.SerialMerger(schema, hierarchies, domain, params, order, bound, d)(grouped)
    return anonymize_items(generalize(grouped, schema, hierarchies), schema, hierarchies, params)


def _extend(grouped: DataFrame, schema: RTSchema, hierarchies: Hierarchies) -> DataFrame:
    """``grouped`` with groups of equal generalized values made one, which ends the serial clustering."""
    groups = group_table(grouped, schema, hierarchies).withColumn("was", F.col("group_id"))
    names = coalesce_classes(groups, schema).select(F.col("was").alias("group_id"), F.col("group_id").alias("new_id"))
    joined = grouped.join(names, "group_id").withColumn("group_id", F.col("new_id"))
    return materialize(joined.select(*grouped.columns), "extended")


# tuning ------------------------------------------------------------------------------------


def sweep(run: Callable[[int], float], step: int, stop: float, most: int) -> list[tuple[int, float]]:
    """(size, milliseconds per unit) for growing sizes, until a step improves it by ``stop`` or less."""
    out: list[tuple[int, float]] = []
    for size in range(step, most + 1, step):
        out.append((size, run(size) / size))
        if len(out) > 1 and out[-2][1] - out[-1][1] <= stop:
            break
    return out


def tune_centers(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, step: int = 100, stop: float = 5.0, most: int = 2000) -> list[tuple[int, float]]:
    """Time of one clustering round by number of centers."""
    rows = materialize(encoded, "tune")
    cost = PairCost.make(schema, hierarchies, domains(rows, schema))

    def run(size: int) -> float:
        began = time.perf_counter()
        cluster.cluster_round(rows, schema, cost, params, size)
        return (time.perf_counter() - began) * 1000

    return sweep(run, step, stop, most)


def tune_merges(grouped: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, step: int = 100, stop: float = 0.3, most: int = 2000) -> list[tuple[int, float]]:
    """Time of one merge round by number of centers."""
    rows = materialize(grouped, "tune")
    domain = domains(rows, schema)

    def run(size: int) -> float:
        began = time.perf_counter()
        merge.merge_rounds(rows, schema, hierarchies, params.with_(max_merges=size), domain, max_rounds=1)
        return (time.perf_counter() - began) * 1000

    return sweep(run, step, stop, most)
