"""Clustering of rows into groups of at least k by relational loss.

Two ways to the same kind of result, (row_id, group_id):

``cluster_rounds``  greedy rounds over the whole table. Each takes the next
    rows as centers (one for equal relational values), finds each center's k
    nearest rows with some slack, and accepts centers by the loss of their
    group and then by id. While more than ``ROUNDS_ROWS`` rows are left, every
    round reads them all; the rounds from there on are made in one task by an
    index, which finds the same rows.
``cluster_blocks``  for any size. Rows are range-partitioned by their
    relational values into blocks, and every block is clustered by itself with
    the serial greedy method. Work in proportion to rows times block size, no
    loop on the driver.

``serial_groups`` is the serial method itself: each group depends on all before
it, so one task holds the relational columns of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Params, RTSchema, SchemaError
from ..scratch import broadcast_if_small, drop_scratch, materialize, ship
from .encode import Hierarchies, domains, with_levels
from .generalize import group_table, relational_columns
from .near_index import CellIndex, batches, bounded, in_one_task, searchable
from .neighbors import PairCost, arrays, nearest
from .order import numbered

BLOCK_ROWS = 2000
#: Rows from which on a serial clustering looks for near rows in an index.
INDEX_ROWS = 10_000
#: Rows whose greedy rounds one task makes.
ROUNDS_ROWS = 12_000_000
#: Rows beyond which a serial clustering is refused; None refuses none.
SERIAL_ROWS: int | None = None


def next_centers(rows: DataFrame, schema: RTSchema, n: int) -> DataFrame:
    """The first ``n`` rows by id; rows with equal relational values are one center, named by the first."""
    keys = relational_columns(schema)
    return rows.orderBy("row_id").limit(n).groupBy(*keys).agg(F.min("row_id").alias("row_id")).select("row_id", *keys)


def next_count(clusters: int, created: int, most: int) -> int:
    """Centers of the next round: halved after a round with under a fifth of groups, one more after a full one, else one less."""
    if created < clusters * 0.2:
        return max(1, clusters // 2)
    if created == clusters and clusters <= most:
        return clusters + 1
    return max(1, clusters - 1)


def accept(found: pd.DataFrame, k: int) -> dict[int, int]:
    """Which row joins which center, from (center, id, cost, place); centers by their k-th cost, then by id."""
    out: dict[int, int] = {}
    groups = [(g["cost"].iloc[min(k, len(g)) - 1], c, g["id"].tolist()) for c, g in found.sort_values(["center", "place"]).groupby("center")]
    for _, center, ids in sorted(groups):
        free = [i for i in ids if i not in out][:k]
        if len(free) == k:
            out.update(dict.fromkeys(free, center))
    return out


def cluster_round(rows: DataFrame, schema: RTSchema, cost: PairCost, params: Params, clusters: int) -> dict[int, int]:
    """One round: row to center, for at most ``clusters`` times k rows, which is all that comes to the driver."""
    found = nearest(rows, next_centers(rows, schema, clusters), cost, params.k + params.conflicts)
    return accept(found.toPandas(), params.k)


def _check_rows(n: int, k: int) -> None:
    if n < k:
        raise SchemaError(f"{n} rows cannot make a group of {k}")


def cluster_rounds(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, domain: dict[str, float] | None = None) -> DataFrame:
    """(row_id, group_id) by greedy rounds; fewer rows than k are an error."""
    spark = encoded.sparkSession
    rows = materialize(encoded.select("row_id", *relational_columns(schema)), "rows")
    n = rows.count()
    _check_rows(n, params.k)
    domain = domains(rows, schema) if domain is None else domain
    cost = PairCost.make(schema, hierarchies, domain)
    clusters, parts, whole = min(params.max_clusters, max(1, n // params.k)), [], rows
    while n >= params.k:
        if n <= ROUNDS_ROWS and bounded(rows, schema):
            done = _rounds_in_task(rows, schema, cost, params, clusters)
            parts.append(done.where("group_id IS NOT NULL"))
            last = done.where("group_id IS NULL").select("row_id")
            rows = materialize(rows.join(F.broadcast(last), "row_id", "left_semi"), "left")  # fewer than k
            n = rows.count()
            break
        joined = cluster_round(rows, schema, cost, params, clusters)
        created = len(set(joined.values()))
        if joined:
            part = materialize(spark.createDataFrame(list(joined.items()), "row_id long, group_id long"), "assigned")
            parts.append(part)
            left = materialize(rows.join(broadcast_if_small(part.select("row_id")), "row_id", "left_anti"), "left")
            if rows is not whole:
                drop_scratch(rows)
            rows, n = left, n - len(joined)
        elif clusters == 1:
            raise RuntimeError("a single center found no group")  # cannot happen: it is the nearest to itself
        clusters = min(next_count(clusters, created, params.max_clusters), max(1, n // params.k or 1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if n:
        out = out.unionByName(attach_leftovers(rows, whole.join(out, "row_id"), schema, hierarchies, cost))
    return out


def greedy_rounds(rows: dict[str, np.ndarray], cost: PairCost, params: Params, clusters: int) -> np.ndarray:
    """Center of each row by the rounds of :func:`cluster_rounds`, -1 for the fewer than k that are left; rows by ascending id."""
    index, k = CellIndex(rows, cost), params.k
    center = np.full(len(rows["id"]), -1, dtype=np.int64)
    keys = [rows[c] for c in relational_columns(cost.schema)]
    first = 0
    while index.n >= k:
        wide, want = 4 * clusters, min(clusters, index.n)
        while len(free := first + np.flatnonzero(center[first : first + wide] < 0)) < want:
            wide *= 2
        first = int(free[0])
        at = list({tuple(v[i] for v in keys): i for i in free[:clusters][::-1].tolist()}.values())
        found = []
        for i in at:
            near, costs = index.nearest(i, k + params.conflicts)
            found.append((costs[min(k, len(costs)) - 1], i, near))
        created, taken = 0, []
        for _, i, near in sorted(found, key=lambda f: f[:2]):
            own = near[center[near] < 0][:k]
            if len(own) == k:
                center[own] = i
                taken.append(own)
                created += 1
        if created:
            index.remove(np.concatenate(taken))
        elif clusters == 1:
            raise RuntimeError("a single center found no group")  # cannot happen: it is the nearest to itself
        clusters = min(next_count(clusters, created, params.max_clusters), max(1, index.n // k))
    return center


def _rounds_in_task(rows: DataFrame, schema: RTSchema, cost: PairCost, params: Params, clusters: int) -> DataFrame:
    """(row_id, group_id) by the rounds that are left; group_id is null for fewer than k rows."""

    def work(data: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        center = greedy_rounds(data, cost, params, clusters)
        for part in batches({"row_id": data["id"], "at": center}):
            named = pd.Series(data["id"][part["at"]], dtype="Int64")
            yield pd.DataFrame({"row_id": part["row_id"].to_numpy(), "group_id": named.mask(part["at"].to_numpy() < 0)})

    return in_one_task(rows, schema, "row_id", work, "row_id long, group_id long", "assigned")


def attach_leftovers(left: DataFrame, grouped: DataFrame, schema: RTSchema, hierarchies: Hierarchies, cost: PairCost) -> DataFrame:
    """(row_id, group_id) for fewer than k rows: each goes to the group that its values extend least."""
    groups = group_table(grouped, schema, hierarchies)
    found = nearest(groups, left, cost, 1, id_column="group_id", center_id="row_id")
    return found.select(F.col("center").alias("row_id"), F.col("id").alias("group_id"))


def serial_clusters(rows: dict[str, np.ndarray], cost: PairCost, k: int, schema: RTSchema, hierarchies: Hierarchies) -> np.ndarray:
    """Group of each row by the serial method: the first free row and its k - 1 nearest, until fewer than k are left.

    The rest go one by one to the group with the least loss times rows, whose
    hull then grows with them.
    """
    n = len(rows["id"])
    group = np.full(n, -1, dtype=np.int64)
    if n > INDEX_ROWS and searchable(rows, cost) and (np.diff(rows["id"]) > 0).all():
        free = _serial_by_index(rows, cost, k, group)
    else:
        free = np.arange(n)
        take = lambda at: {c: v[at] for c, v in rows.items()}
        while len(free) >= k:
            near = cost(take(free), take(free[:1]))[:, 0]
            near[0] = -1.0
            chosen = np.lexsort((rows["id"][free], near))[:k]
            group[free[chosen]] = rows["id"][free[0]]
            free = np.delete(free, chosen)
    if len(free) and (group >= 0).any():
        _join_leftovers(rows, group, free, cost, hierarchies)
    return group


def _serial_by_index(rows: dict[str, np.ndarray], cost: PairCost, k: int, group: np.ndarray) -> np.ndarray:
    """Fills ``group`` of rows by ascending id, until fewer than k are left; those."""
    index, first = CellIndex(rows, cost), 0
    while index.n >= k:
        while group[first] >= 0:
            first += 1
        group[first] = rows["id"][first]
        index.remove(np.array([first]))
        if k > 1:
            near, _ = index.nearest(first, k - 1)
            group[near] = rows["id"][first]
            index.remove(near)
    return np.flatnonzero(group < 0)


def _join_leftovers(rows: dict[str, np.ndarray], group: np.ndarray, free: np.ndarray, cost: PairCost, hierarchies: Hierarchies) -> None:
    """Each row of ``free`` goes to the group with the least loss times rows."""
    member = np.flatnonzero(group >= 0)
    member = member[np.argsort(group[member], kind="stable")]
    names, starts, sizes = np.unique(group[member], return_index=True, return_counts=True)
    hull = {"id": names, "n_rows": sizes.astype(float)}
    for c, v in rows.items():
        if c.endswith("_lo"):
            hull[c] = np.minimum.reduceat(v[member], starts)
        elif c.endswith("_hi"):
            hull[c] = np.maximum.reduceat(v[member], starts)
        elif c.startswith("c_"):
            h = hierarchies[c[2:]]
            above = np.full((h.size, h.height + 1), -1, dtype=np.int64)
            for x in range(h.size):
                for y in h.path(x):
                    above[x, h.depth(y)] = y
            hull[c] = np.full(len(names), h.root, dtype=np.int64)
            for depth in range(1, h.height + 1):
                node = above[v[member], depth]
                low, high = np.minimum.reduceat(node, starts), np.maximum.reduceat(node, starts)
                hull[c] = np.where((low == high) & (low >= 0), low, hull[c])
    for i in free:
        row = {c: v[[i]] for c, v in rows.items()}
        best = int(np.argmin(cost(hull, row)[:, 0] * hull["n_rows"]))
        group[i] = names[best]
        hull["n_rows"][best] += 1
        for c in rows:
            if c.endswith("_lo"):
                hull[c][best] = min(hull[c][best], row[c][0])
            elif c.endswith("_hi"):
                hull[c][best] = max(hull[c][best], row[c][0])
            elif c.startswith("c_"):
                hull[c][best] = hierarchies[c[2:]].lca(int(hull[c][best]), int(row[c][0]))


def cluster_blocks(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, domain: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, serial: bool = False) -> DataFrame:
    """(row_id, group_id) by blocks of near values; fewer rows than k are an error.

    Blocks are cut at exact places of the order by relational values and
    row_id, so they do not depend on how the rows are dealt out. A block has
    ``block_rows`` rows or more, and less than twice as many. ``serial`` takes
    a block's rows by row_id, and the weighted loss.
    """
    spark = encoded.sparkSession
    ship(spark)
    rows = with_levels(encoded.select("row_id", *relational_columns(schema)), schema, hierarchies)
    n = rows.count()
    _check_rows(n, params.k)
    domain = domains(encoded, schema) if domain is None else domain
    cost = PairCost.make(schema, hierarchies, domain, serial=serial)
    order = [f"c_{c}_l{i}" for c in schema.categorical for i in range(hierarchies[c].height + 1)]
    order += [f"n_{x}_lo" for x in schema.numeric] + ["row_id"]
    size = max(block_rows, 2 * params.k)
    k = params.k

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        data = arrays(pdf.sort_values("row_id" if serial else "place", kind="stable"), schema, "row_id")
        return pd.DataFrame({"row_id": data["id"], "group_id": serial_clusters(data, cost, k, schema, hierarchies)})

    placed = numbered(rows, order).select("row_id", *relational_columns(schema), F.col("place"))
    block = F.least(F.floor(F.col("place") / size), F.lit(max(n // size, 1) - 1)).alias("block")
    return materialize(placed.withColumn("block", block).groupBy("block").applyInPandas(one, "row_id long, group_id long"), "blocks")


def serial_groups(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, domain: dict[str, float] | None = None) -> DataFrame:
    """(row_id, group_id) by the serial method over the whole table, in one task; more than ``SERIAL_ROWS`` rows are an error, if that is set."""
    rows = materialize(encoded.select("row_id", *relational_columns(schema)), "rows")
    n = rows.count()
    if SERIAL_ROWS is not None and n > SERIAL_ROWS:
        raise SchemaError(f"over {SERIAL_ROWS} rows: use cluster_blocks or cluster_rounds")
    _check_rows(n, params.k)
    cost = PairCost.make(schema, hierarchies, domains(rows, schema) if domain is None else domain, serial=True)

    def work(data: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        yield from batches({"row_id": data["id"], "group_id": serial_clusters(data, cost, params.k, schema, hierarchies)})

    return in_one_task(rows, schema, "row_id", work, "row_id long, group_id long", "serial")
