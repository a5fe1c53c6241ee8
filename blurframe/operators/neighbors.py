"""Nearest rows or groups by relational loss.

A bounded set of centers is broadcast; each partition keeps only the best few
candidates of each center (a partial top-k), so what is shuffled is bounded by
centers times k times partitions and no pair table exists. Costs come from
numpy: a matrix of common-ancestor costs per categorical column and interval
hulls per numeric one. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import RTSchema, SchemaError
from ..scratch import ship
from .encode import Hierarchies
from .generalize import relational_columns

MAX_CENTERS = 20_000


@dataclass
class PairCost:
    """Loss of the generalization of two rows or groups."""

    schema: RTSchema
    tables: dict[str, np.ndarray]  # (node, node) -> cost of the lowest common ancestor
    domain: dict[str, float]

    @classmethod
    def make(cls, schema: RTSchema, hierarchies: Hierarchies, domain: dict[str, float], serial: bool = False) -> PairCost:
        tables = {}
        for c in schema.categorical:
            h = hierarchies[c]
            own = np.array([0.0 if serial and h.leaf_counts[i] < 2 else h.leaf_frac(i) for i in range(h.size)])
            table = np.full((h.size, h.size), own[h.root])
            # deeper subtrees overwrite what their ancestors set
            for node in range(h.size):
                inside = np.array([node, *h.crawl_down(node)])
                table[np.ix_(inside, inside)] = own[node]
            tables[c] = table * (schema.weight(c) if serial else 1.0)
        scale = {n: (schema.weight(n) if serial else 1.0) for n in schema.numeric}
        return cls(schema, tables, {n: domain[n] / scale[n] if scale[n] else np.inf for n in schema.numeric})

    def __call__(self, rows: dict[str, np.ndarray], centers: dict[str, np.ndarray]) -> np.ndarray:
        """(rows, centers) matrix of losses."""
        out = np.zeros((len(rows["id"]), len(centers["id"])))
        for c in self.schema.categorical:
            out += self.tables[c][rows[f"c_{c}"][:, None], centers[f"c_{c}"][None, :]]
        for n in self.schema.numeric:
            lo = np.minimum(rows[f"n_{n}_lo"][:, None], centers[f"n_{n}_lo"][None, :])
            width = np.maximum(rows[f"n_{n}_hi"][:, None], centers[f"n_{n}_hi"][None, :]) - lo
            if self.domain[n] > 0:
                out += np.where(width > 0, width / self.domain[n], 0.0)
        return out


def arrays(pdf: pd.DataFrame, schema: RTSchema, id_column: str) -> dict[str, np.ndarray]:
    out = {"id": pdf[id_column].to_numpy(dtype=np.int64)}
    for c in relational_columns(schema):
        out[c] = pdf[c].to_numpy(dtype=np.int64 if c.startswith("c_") else float)
    for c in ("n_rows", "ncp"):
        if c in pdf:
            out[c] = pdf[c].to_numpy(dtype=float)
    return out


#: What is minimised: the pair's loss; the loss that merging adds; merged loss less the candidate's.
COSTS = ("pair", "merge", "quick")


def nearest(rows: DataFrame, centers: DataFrame, cost: PairCost, k: int, id_column: str = "row_id", center_id: str | None = None, measure: str = "pair", exclude: set[int] | None = None) -> DataFrame:
    """(center, id, cost, place): the ``k`` nearest of ``rows`` for each of ``centers``.

    ``centers`` may have ``MAX_CENTERS`` rows at most; they come to the driver.
    ``merge`` and ``quick`` need n_rows and ncp on both sides. Ids in
    ``exclude`` are no candidates.
    """
    spark, schema = rows.sparkSession, cost.schema
    ship(spark)
    center_id = center_id or id_column
    some = centers.limit(MAX_CENTERS + 1).toPandas()
    if len(some) > MAX_CENTERS:
        raise SchemaError(f"over {MAX_CENTERS} centers")
    some = some.sort_values(center_id, kind="stable")
    held = spark.sparkContext.broadcast((arrays(some, schema, center_id), np.array(sorted(exclude or ()), dtype=np.int64)))
    block = max(1, 4_000_000 // max(len(some), 1))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out = held.value
        m = len(at["id"])
        ids, costs = np.zeros((m, 0), dtype=np.int64), np.zeros((m, 0))
        for batch in batches:
            every = arrays(batch, schema, id_column)
            if len(out):
                keep = ~np.isin(every["id"], out)
                every = {c: v[keep] for c, v in every.items()}
            for i in range(0, len(every["id"]), block):
                part = {c: v[i : i + block] for c, v in every.items()}
                new = cost(part, at).T
                if measure != "pair":
                    new = new * (part["n_rows"][None, :] + at["n_rows"][:, None])
                    new = new - part["ncp"][None, :] - (at["ncp"][:, None] if measure == "merge" else 0.0)
                ids = np.concatenate([ids, np.broadcast_to(part["id"], new.shape)], axis=1)
                costs = np.concatenate([costs, new], axis=1)
                if ids.shape[1] > k:
                    order = np.lexsort((ids, costs), axis=1)[:, :k]
                    ids, costs = np.take_along_axis(ids, order, 1), np.take_along_axis(costs, order, 1)
        if m and ids.shape[1]:
            yield pd.DataFrame({"center": np.repeat(at["id"], ids.shape[1]), "id": ids.reshape(-1), "cost": costs.reshape(-1)})

    columns = [id_column, *relational_columns(schema), *(c for c in ("n_rows", "ncp") if c in rows.columns)]
    found = rows.select(*columns).mapInPandas(best, "center long, id long, cost double")
    place = F.row_number().over(Window.partitionBy("center").orderBy("cost", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
