"""Merging of groups: trading relational loss for item loss.

Distributed: :func:`merge_rounds` (by item loss gained per relational loss
added) and :func:`quick_merge` (by relational loss alone). Both loop on the
driver over the table of groups; a round reads that table once, sends a
bounded set of centers out and brings back one candidate per center. Rows are
relabelled once, at the end. Up to ``QUICK_GROUPS`` groups, one task makes the
rounds of :func:`quick_merge` with an index, which finds the same partners.

Serial: :class:`SerialMerger` merges one pair at a time with one of six
combinations of partner order and acceptance rule, in one task. Groups, any
number of them, are arrays there, and their distinct baskets are bits.

Item losses are whole numbers of any size: they are made in Python and kept as
text, and only their ratios, which order the candidates, are doubles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..hierarchy import Hierarchy
from ..functions import gain, ncp_ul_ratio
from ..schema import Params, RTSchema, SchemaError
from ..scratch import broadcast_if_small, materialize, ship
from .encode import Hierarchies
from .generalize import group_ncp, group_table, merge_groups, relational_columns
from .items import HierarchyCut, SetMerge, _distinct_baskets, _rows
from .near_index import CellIndex, batches, bounded, in_one_task
from .neighbors import PairCost, arrays, nearest
from .serial_table import SerialTable
from .serial_table import ancestors as _ancestors
from .serial_table import distance as _distance

#: Groups up to which serial merging looks at every pair, one by one.
SERIAL_SCAN = 100
#: Groups whose quick merging is made in one task, and up to which every pair is looked at there.
QUICK_GROUPS, SCAN_GROUPS = 5_000_000, 3000
#: Rounds whose gains set the bound under which merging stops: a tenth of their mean.
BOUND_ROUNDS = 10
#: Sets on either side that are compared at once.
_BTD_ROWS, _BTD_OTHERS = 256, 8192
#: Digits of a whole number that are summed at once.
_DIGITS = 15
#: Every double is a whole number of parts of this size.
_ONE = 1 << 1074


def class_ul(baskets: list[tuple[tuple[int, ...], int]], hierarchy: Hierarchy, params: Params) -> int:
    """Item loss of one class once its items are anonymized, exactly."""
    if params.ul == "hierarchy":
        goes = HierarchyCut(hierarchy, params.k, params.m, params.mode)(baskets)
        return sum(n * hierarchy.ul_weight(y) for items, n in baskets for y in {goes[x] for x in items})
    of = SetMerge(params.k, params.m)(baskets)
    return sum(n * (2 ** len(s) - 1) for items, n in baskets for s in {of[x] for x in items} if len(s) > 1)


def _ul_of_groups(baskets: DataFrame, key: str, hierarchy: Hierarchy, params: Params) -> DataFrame:
    """(key, ul as text) from ``baskets(key, items, n)``."""
    ship(baskets.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ul": [str(class_ul(_rows(pdf), hierarchy, params))]})

    return baskets.groupBy(key).applyInPandas(run, f"{key} long, ul string")


def group_ul(encoded: DataFrame, hierarchy: Hierarchy, params: Params) -> DataFrame:
    """(group_id, ul): each group's item loss once anonymized; a whole number of any size, as text."""
    return _ul_of_groups(_distinct_baskets(encoded), "group_id", hierarchy, params)


def exact_total(losses: DataFrame, column: str = "ul") -> int:
    """The sum of whole numbers that are given as text, exactly: their digits are summed in parts."""
    part = f"cast(reverse(substring(reverse({column}), cast(i * {_DIGITS} + 1 as int), {_DIGITS})) as decimal(38,0))"
    parts = F.posexplode(F.expr(f"transform(sequence(0, cast((length({column}) - 1) div {_DIGITS} as int)), i -> {part})"))
    rows = losses.select(parts).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return sum(int(r["s"]) * 10 ** (_DIGITS * r["pos"]) for r in rows)


def _difference(merged: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([str(int(m) - int(a) - int(b)) for m, a, b in zip(merged, one, other)], dtype=object)


def lowest(groups: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` groups with the least ``by``; ties go to the smaller id."""
    return groups.orderBy(by, "group_id").limit(n)


@dataclass
class MergeLog:
    """What the rounds did: (relational loss, item loss, merges) after each."""

    rounds: list[tuple[float, int, int]] = field(default_factory=list)


def next_tree(tree: int, merged: int, merges: int, params: Params) -> tuple[int, bool]:
    """Candidates per center of the next round, and whether the change alone calls for one."""
    if merged < merges * 0.1:
        return (tree + 1, True) if tree < params.max_tree else (tree, False)
    return max(params.min_tree, tree - 1), False


def _halve(merges: int, groups: int) -> int:
    return groups // 2 if groups <= merges else merges


def merge_candidates(groups: DataFrame, baskets: DataFrame, centers: DataFrame, cost: PairCost, hierarchy: Hierarchy, params: Params, tree: int) -> DataFrame:
    """(center, id, ncp_diff, ul_diff, merged_ul): the ``tree`` cheapest partners of each center, with exact item losses as text.

    ``groups`` has ncp and ul; ``baskets`` (group_id, items, n) the distinct
    item sets. Item losses are only made for partners that the relational
    loss lets through.
    """
    ids = {r["group_id"] for r in centers.select("group_id").collect()}
    short = nearest(groups, centers, cost, tree, id_column="group_id", measure="merge", exclude=ids)
    short = short.select("center", "id", F.col("cost").alias("ncp_diff"), F.row_number().over(Window.orderBy("center", "id")).cast("long").alias("pair"))
    short = materialize(short, "short")
    sides = short.select("pair", F.col("center").alias("group_id")).unionByName(short.select("pair", F.col("id").alias("group_id")))
    together = sides.join(baskets, "group_id").groupBy("pair", "items").agg(F.sum("n").alias("n"))
    merged = _ul_of_groups(together, "pair", hierarchy, params)
    uls = groups.select("group_id", F.col("ul").alias("own"))
    out = short.join(merged, "pair").join(uls.withColumnsRenamed({"group_id": "center", "own": "ul_c"}), "center").join(uls.withColumnsRenamed({"group_id": "id", "own": "ul_i"}), "id")
    return out.select("center", "id", "ncp_diff", F.pandas_udf(_difference, "string")("ul", "ul_c", "ul_i").alias("ul_diff"), F.col("ul").alias("merged_ul"))


def merge_rounds(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, domain: dict[str, float], log: MergeLog | None = None, max_rounds: int | None = None) -> DataFrame:
    """``encoded`` with merged ``group_id``: merges that lower the item loss, best gain first, while the relational loss stays below its bound.

    A center takes in one group per round. Rounds end when none changes
    anything, a loss bound is reached, or the gain falls below a tenth of the
    mean of the first ten rounds.
    """
    h = hierarchies[schema.items]
    cost = PairCost.make(schema, hierarchies, domain)
    groups = group_ncp(group_table(encoded, schema, hierarchies), schema, hierarchies, domain)
    groups = materialize(groups.join(group_ul(encoded, h, params), "group_id"), "groups")
    baskets = materialize(_distinct_baskets(encoded), "baskets")
    total = groups.agg(F.sum("ncp").alias("ncp"), F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("g")).first()
    ncp, ul, n, count = float(total["ncp"] or 0), exact_total(groups), int(total["n"] or 0), total["g"]
    rd, td = params.scaled(n, schema.n_relational, h.n_leaves)
    new_name: dict[int, int] = {}
    tree, merges, done, bound = params.min_tree, params.max_merges, 0, 0.0
    while count > 1 and (max_rounds is None or done < max_rounds):
        merges = _halve(merges, count)
        ranked = groups.withColumn("ratio", ncp_ul_ratio(F.col("ncp"), F.col("ul").cast("double")))
        centers = materialize(lowest(ranked, "ratio", merges), "centers")
        found = merge_candidates(groups, baskets, centers, cost, h, params, tree).where("ul_diff LIKE '-%'")
        found = found.withColumn("gain", gain(F.col("ul_diff"), F.col("ncp_diff"), params.mode)).toPandas()
        best = found.sort_values(["gain", "id"]).drop_duplicates("center")
        gained, mapping = 0, {}
        for r in best.itertuples():
            if r.id in mapping:
                continue
            if ncp + r.ncp_diff < rd:
                ncp, gained, mapping[r.id] = ncp + r.ncp_diff, gained + int(r.ul_diff), r.center
        ul += gained
        changed = bool(mapping)
        tree, again = next_tree(tree, len(mapping), merges, params)
        changed = changed or again
        if done < BOUND_ROUNDS:
            bound += gained / (BOUND_ROUNDS * BOUND_ROUNDS)
        elif gained > bound:
            changed = False
        if mapping:
            moved = encoded.sparkSession.createDataFrame([(int(a), int(b)) for a, b in mapping.items()], "group_id long, new_id long")
            new_ul = best[best["id"].isin(mapping)][["center", "merged_ul"]]
            fresh = encoded.sparkSession.createDataFrame([(int(c), str(u)) for c, u in new_ul.itertuples(index=False)], "group_id long, fresh string")
            uls = groups.select("group_id", "ul").join(F.broadcast(moved), "group_id", "left_anti").join(F.broadcast(fresh), "group_id", "left").select("group_id", F.coalesce("fresh", "ul").alias("ul"))
            shape = merge_groups(groups.select("group_id", "n_rows", *relational_columns(schema)), F.broadcast(moved), schema, hierarchies)
            groups = materialize(group_ncp(shape, schema, hierarchies, domain).join(uls, "group_id"), "groups")
            named = baskets.join(F.broadcast(moved), "group_id", "left").select(F.coalesce("new_id", "group_id").alias("group_id"), "items", "n")
            baskets = materialize(named.groupBy("group_id", "items").agg(F.sum("n").alias("n")), "baskets")
            new_name.update(mapping)
            count -= len(mapping)
        done += 1
        if log is not None:
            log.rounds.append((ncp, ul, len(mapping)))
        if not changed or ncp >= rd or ul <= td:
            break
    return relabel(encoded, new_name)


def quick_merge(encoded: DataFrame, schema: RTSchema, hierarchies: Hierarchies, params: Params, domain: dict[str, float], log: MergeLog | None = None, max_rounds: int | None = None) -> DataFrame:
    """``encoded`` with merged ``group_id``, by relational loss alone: the groups with the least loss each take in the partner that adds least."""
    cost = PairCost.make(schema, hierarchies, domain)
    groups = materialize(group_ncp(group_table(encoded, schema, hierarchies), schema, hierarchies, domain), "groups")
    total = groups.agg(F.sum("ncp").alias("ncp"), F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("g")).first()
    ncp, n, count = float(total["ncp"] or 0), int(total["n"] or 0), total["g"]
    rd, _ = params.scaled(n, schema.n_relational, 1)
    if count <= QUICK_GROUPS and bounded(groups, schema):
        return _quick_in_task(encoded, groups, cost, hierarchies, params, ncp, rd, log, max_rounds)
    merges, done, new_name = params.max_merges, 0, {}
    while count > 1 and ncp < rd and (max_rounds is None or done < max_rounds):
        merges = _halve(merges, count)
        centers = materialize(lowest(groups, "ncp", merges), "centers")
        own = {r["group_id"]: r["ncp"] for r in centers.select("group_id", "ncp").collect()}
        found = nearest(groups, centers, cost, 1, id_column="group_id", measure="quick", exclude=set(own)).toPandas()
        mapping = {}
        for r in found.sort_values(["cost", "center"]).itertuples():
            difference = r.cost - own[r.center]
            if r.id not in mapping and ncp + difference < rd:
                ncp, mapping[r.id] = ncp + difference, r.center
        done += 1
        if log is not None:
            log.rounds.append((ncp, 0, len(mapping)))
        if not mapping:
            break
        moved = encoded.sparkSession.createDataFrame([(int(a), int(b)) for a, b in mapping.items()], "group_id long, new_id long")
        shape = merge_groups(groups.select("group_id", "n_rows", *relational_columns(schema)), F.broadcast(moved), schema, hierarchies)
        groups = materialize(group_ncp(shape, schema, hierarchies, domain), "groups")
        new_name.update(mapping)
        count -= len(mapping)
    return relabel(encoded, new_name)


def _cheapest(groups: dict[str, np.ndarray], centers: np.ndarray, cost: PairCost) -> tuple[np.ndarray, np.ndarray]:
    """Each center's partner among the other groups, with the merged loss less the partner's; ties go to the smaller id."""
    n = len(groups["id"])
    partner, losses = np.empty(len(centers), dtype=np.int64), np.empty(len(centers))
    if n <= SCAN_GROUPS:
        rest = np.delete(np.arange(n), centers)
        take = lambda at: {c: v[at] for c, v in groups.items()}
        table = cost(take(rest), take(centers)).T
        table = table * (groups["n_rows"][rest][None, :] + groups["n_rows"][centers][:, None]) - groups["ncp"][rest][None, :]
        best = table.argmin(axis=1)
        return rest[best], table[np.arange(len(centers)), best]
    index = CellIndex(groups, cost)
    index.remove(centers)
    for j, i in enumerate(centers):
        own = groups["n_rows"][i]
        value = lambda at, costs, own=own: costs * (groups["n_rows"][at] + own) - groups["ncp"][at]
        # a partner's own loss is no more than the merged one for each of its rows, so the center's rows alone bound the difference, but for rounding
        at, loss = index.nearest(int(i), 1, value, float(own) * (1 - 1e-6))
        partner[j], losses[j] = at[0], loss[0]
    return partner, losses


def quick_rounds(groups: dict[str, np.ndarray], cost: PairCost, hierarchies: Hierarchies, params: Params, ncp: float, rd: float, max_rounds: int | None = None) -> tuple[dict[int, int], list[tuple[float, int, int]]]:
    """(names, log) of the rounds of :func:`quick_merge`, from arrays of groups by ascending id."""
    schema = cost.schema
    together = {c: _ancestors(hierarchies[c]) for c in schema.categorical}
    share = {c: np.array([hierarchies[c].leaf_frac(i) for i in range(hierarchies[c].size)]) for c in schema.categorical}
    groups = {c: v.copy() for c, v in groups.items()}
    merges, log, moves = params.max_merges, [], []
    while len(groups["id"]) > 1 and ncp < rd and (max_rounds is None or len(log) < max_rounds):
        merges = _halve(merges, len(groups["id"]))
        least = np.flatnonzero(groups["ncp"] <= np.partition(groups["ncp"], merges - 1)[merges - 1])
        centers = least[np.lexsort((least, groups["ncp"][least]))][:merges]
        partner, losses = _cheapest(groups, centers, cost)
        own, taken, pairs = groups["ncp"][centers], set(), []
        for j in np.lexsort((centers, losses)).tolist():
            difference, p = float(losses[j] - own[j]), int(partner[j])
            if p not in taken and ncp + difference < rd:
                ncp += difference
                taken.add(p)
                pairs.append((int(centers[j]), p))
        log.append((ncp, 0, len(pairs)))
        if not pairs:
            break
        a, b = np.array(pairs).T
        moves.append((groups["id"][b], groups["id"][a]))
        one = np.zeros(len(a))
        groups["n_rows"][a] += groups["n_rows"][b]
        for c in schema.categorical:
            groups[f"c_{c}"][a] = together[c][groups[f"c_{c}"][a], groups[f"c_{c}"][b]]
            one += share[c][groups[f"c_{c}"][a]]
        for x in schema.numeric:
            lo, hi = f"n_{x}_lo", f"n_{x}_hi"
            groups[lo][a], groups[hi][a] = np.minimum(groups[lo][a], groups[lo][b]), np.maximum(groups[hi][a], groups[hi][b])
            if cost.domain[x] > 0:
                one += (groups[hi][a] - groups[lo][a]) / cost.domain[x]
        groups["ncp"][a] = one * groups["n_rows"][a]
        groups = {c: np.delete(v, b) for c, v in groups.items()}
    names: dict[int, int] = {}
    for gone, into in reversed(moves):
        for g, c in zip(gone.tolist(), into.tolist()):
            names[g] = names.get(c, c)  # the last name, as later merges are in already
    return names, log


def _quick_in_task(encoded: DataFrame, groups: DataFrame, cost: PairCost, hierarchies: Hierarchies, params: Params, ncp: float, rd: float, log: MergeLog | None, max_rounds: int | None) -> DataFrame:
    """``encoded`` with the groups of :func:`quick_rounds`."""

    def work(data: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        names, rounds = quick_rounds(data, cost, hierarchies, params, ncp, rd, max_rounds)
        yield pd.DataFrame({"round": range(len(rounds)), "group_id": -1, "new_id": [r[2] for r in rounds], "ncp": [r[0] for r in rounds]})
        for part in batches({"group_id": np.array(list(names), dtype=np.int64), "new_id": np.array(list(names.values()), dtype=np.int64)}):
            yield part.assign(round=-1, ncp=0.0)[["round", "group_id", "new_id", "ncp"]]

    done = in_one_task(groups, cost.schema, "group_id", work, "round int, group_id long, new_id long, ncp double", "merged")
    if log is not None:
        log.rounds += [(r["ncp"], 0, r["new_id"]) for r in done.where("round >= 0").orderBy("round").collect()]
    names = broadcast_if_small(done.where("round < 0").select("group_id", "new_id"))
    out = encoded.join(names, "group_id", "left").withColumn("group_id", F.coalesce("new_id", "group_id")).drop("new_id")
    return out.select(*encoded.columns)


def resolve(names: dict[int, int]) -> dict[int, int]:
    """Each merged group's last name, through all groups that took it in."""
    out = {}
    for g in names:
        x = g
        while x in names:
            x = names[x]
        out[g] = x
    return out


def relabel(encoded: DataFrame, names: dict[int, int]) -> DataFrame:
    """``encoded`` with its groups renamed."""
    if not names:
        return encoded
    final = encoded.sparkSession.createDataFrame([(int(a), int(b)) for a, b in resolve(names).items()], "group_id long, new_id long")
    out = encoded.join(final, "group_id", "left").withColumn("group_id", F.coalesce("new_id", "group_id")).drop("new_id")
    return out.select(*encoded.columns)


# set distances ---------------------------------------------------------------------------


def btd_value(a: frozenset, b: frozenset) -> float:
    """Distance of two item sets: (|a xor b| + 1) |a or b| / (|a and b| + 1)."""
    return (len(a ^ b) + 1) * len(a | b) / (len(a & b) + 1)


class _Part:
    """Item sets as bits (a row of 64 items, a column a set) with their counts."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray):
        self.bits, self.counts, self.known = bits, counts, {}

    def rows_with(self, items: int) -> int:
        """Rows that hold any of ``items``, a whole number whose bits they are."""
        if items not in self.known:
            hit = np.zeros(len(self.counts), dtype=bool)
            for w, word in enumerate(self.bits):
                some = (items >> (64 * w)) & (2**64 - 1)
                if some:
                    hit |= (word & np.uint64(some)) != 0
            self.known[items] = int(self.counts[hit].sum())
        return self.known[items]


class Baskets:
    """A group's item sets with their counts, as parts that groups share; a set may stand in several parts."""

    def __init__(self, parts: list[_Part]):
        self.parts = parts

    @classmethod
    def of(cls, sets: Counter) -> Baskets:
        words = max((x for s in sets for x in s), default=0) // 64 + 1
        bits = np.zeros((words, len(sets)), dtype=np.uint64)
        for r, s in enumerate(sets):
            for x in s:
                bits[x // 64, r] |= np.uint64(1 << x % 64)
        return cls([_Part(bits, np.array(list(sets.values()), dtype=np.int64))])

    def __add__(self, other: Baskets) -> Baskets:
        return Baskets(self.parts + other.parts)

    def rows_with(self, items: int) -> int:
        return sum(p.rows_with(items) for p in self.parts)

    def pairs(self) -> list[tuple[tuple[int, ...], int]]:
        """(items, count), sorted."""
        out: Counter = Counter()
        for p in self.parts:
            for r, n in enumerate(p.counts.tolist()):
                out[tuple(64 * w + x for w, word in enumerate(p.bits[:, r].tolist()) for x in range(64) if word >> x & 1)] += n
        return sorted(out.items())

    @cached_property
    def by_size(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By the number of items: bits (a row a set), whether the set occurs twice, and what all sets have in common."""
        words = max(len(p.bits) for p in self.parts)
        bits = np.concatenate([np.pad(p.bits, ((0, words - len(p.bits)), (0, 0))) for p in self.parts], axis=1)
        twice = np.concatenate([p.counts for p in self.parts]) > 1
        size = np.bitwise_count(bits).sum(axis=0, dtype=np.int64)
        out = {}
        for s in np.unique(size).tolist():
            own = np.ascontiguousarray(bits[:, size == s].T)
            out[s] = own, twice[size == s], np.bitwise_and.reduce(own, axis=0)
        return out

    @cached_property
    def within(self) -> float:
        """The largest distance between two rows of the group."""
        return self.farthest(self, 0.0)

    def farthest(self, other: Baskets, most: float) -> float:
        """The largest distance between a row of each group, or ``most`` if that is more.

        For two sizes, the distance falls with the number of common items. So
        sizes are taken by the distance that they allow at most, and compared
        until two sets with the least possible number are found.
        """
        todo = []
        for s, (x, _, of_x) in self.by_size.items():
            for t, (y, _, of_y) in other.by_size.items():
                if other is not self or s <= t:
                    words = min(len(of_x), len(of_y))
                    least = int(np.bitwise_count(of_x[:words] & of_y[:words]).sum())
                    todo.append((_distance(s, t, least), s, t, least))
        for bound, s, t, least in sorted(todo, reverse=True):
            if bound <= most:
                break
            x, twice, _ = self.by_size[s]
            common = _least_common(x, other.by_size[t][0], least, twice if other is self and s == t else None)
            if common is not None:
                most = max(most, _distance(s, t, common))
        return most


def _least_common(x: np.ndarray, y: np.ndarray, least: int, twice: np.ndarray | None) -> int | None:
    """The least number of common items of a set of x and one of y, at least ``least``; with ``twice``, y is x and a set is its own partner where it occurs twice."""
    best, words = None, min(x.shape[1], y.shape[1])
    for a in range(0, len(x), _BTD_ROWS):
        for b in range(0 if twice is None else a, len(y), _BTD_OTHERS):
            both = np.zeros((len(x[a : a + _BTD_ROWS]), len(y[b : b + _BTD_OTHERS])), dtype=np.int32)
            for w in range(words):
                both += np.bitwise_count(x[a : a + _BTD_ROWS, None, w] & y[None, b : b + _BTD_OTHERS, w])
            if twice is not None:
                own = np.arange(max(a, b), min(a + both.shape[0], b + both.shape[1]))
                own = own[~twice[own]]
                both[own - a, own - b] = np.iinfo(np.int32).max
            found = int(both.min())
            if found < np.iinfo(np.int32).max and (best is None or found < best):
                best = found
                if best <= least:
                    return best
    return best


def btd_groups(a: Counter | Baskets, b: Counter | Baskets) -> float:
    """The largest distance between any two rows of the two groups together."""
    a, b = (x if isinstance(x, Baskets) else Baskets.of(x) for x in (a, b))
    return a.farthest(b, max(a.within, b.within))


def dense_ranks(values: dict[int, float]) -> dict[int, int]:
    order = {v: i + 1 for i, v in enumerate(sorted(set(values.values())))}
    return {k: order[v] for k, v in values.items()}


# serial merging --------------------------------------------------------------------------


@dataclass
class _Group:
    n: int
    lo: dict[str, float]
    hi: dict[str, float]
    cat: dict[str, int]
    baskets: Baskets


class SerialMerger:
    """One merge at a time: the group with the least loss takes a partner.

    ``order``  partners by relational loss ("R"), by item distance ("T"), or by
        the sum of both ranks ("RT").
    ``bound``  "ncp": accept while the total relational loss stays within d
        (R tries its first partner only; T and RT the first that fits); stop at
        the first group that finds none. "ul": accept when the item loss does
        not rise; stop when it reaches d or every group has been tried.
    """

    ORDERS, BOUNDS = ("R", "T", "RT"), ("ncp", "ul")

    def __init__(self, schema: RTSchema, hierarchies: Hierarchies, domain: dict[str, float], params: Params, order: str, bound: str, d: float):
        if order not in self.ORDERS or bound not in self.BOUNDS:
            raise SchemaError(f"order is one of {self.ORDERS} and bound one of {self.BOUNDS}")
        self.schema, self.h, self.domain, self.params, self.order, self.bound, self.d = schema, hierarchies, domain, params, order, bound, d

    def _one(self, g: _Group) -> float:
        out = 0.0
        for c, x in g.cat.items():
            h = self.h[c]
            if h.leaf_counts[x] > 1:
                out += h.leaf_frac(x) * self.schema.weight(c)
        for x in g.lo:
            if self.domain[x] > 0:
                out += (g.hi[x] - g.lo[x]) / self.domain[x] * self.schema.weight(x)
        return out

    def _join(self, a: _Group, b: _Group) -> _Group:
        return _Group(
            a.n + b.n,
            {x: min(a.lo[x], b.lo[x]) for x in a.lo},
            {x: max(a.hi[x], b.hi[x]) for x in a.hi},
            {c: self.h[c].lca(a.cat[c], b.cat[c]) for c in a.cat},
            a.baskets + b.baskets,
        )

    @cached_property
    def _below(self) -> list[int]:
        """Each node of the items' hierarchy with all that is below it, as bits."""
        h = self.h[self.schema.items]
        return [sum(1 << y for y in (x, *h.crawl_down(x))) for x in range(h.size)]

    def _ul(self, g: _Group) -> int:
        """Item loss of one group, as :func:`class_ul` has it; where single items need support, from counts of rows alone."""
        h = self.h[self.schema.items]
        if self.params.ul != "hierarchy" or self.params.m > 1:
            return class_ul(g.baskets.pairs(), h, self.params)
        support = Counter({(x,): n for x in range(h.size) if (n := g.baskets.rows_with(self._below[x]))})
        goes = {x: x for x in range(h.size) if g.baskets.rows_with(1 << x)}
        cut = HierarchyCut(h, self.params.k, 1, self.params.mode)
        for rule in cut._rules(support, Counter(), 1):
            goes = {x: rule if y in cut.below[rule] else y for x, y in goes.items()}
        items, out = sum(1 << x for x in goes), 0
        for y in set(goes.values()):
            own = sum(1 << x for x in goes if goes[x] == y)
            whole = own == items & self._below[y]  # then the rows are counted already
            out += h.ul_weight(y) * (support[(y,)] if whole else g.baskets.rows_with(own))
        return out

    def merge(self, groups: dict[int, _Group]) -> dict[int, int]:
        """Which group each absorbed group went into."""
        rows = sum(g.n for g in groups.values())
        loss = {i: self._one(g) * g.n / rows for i, g in groups.items()}
        uls = {i: self._ul(g) for i, g in groups.items()} if self.bound == "ul" else {}
        limit = self.d * (2 ** self.h[self.schema.items].n_leaves - 1) * rows if self.bound == "ul" else self.d
        names: dict[int, int] = {}
        waiting = dict(loss)
        while len(groups) > 1 and waiting:
            # reference mode looks at the bound after a merge only, strict mode before the first too
            if self.bound == "ul" and (names or self.params.mode == "strict") and sum(uls.values()) <= limit:
                break
            c = min(waiting, key=lambda i: (waiting[i], i))
            del waiting[c]
            center = groups[c]
            merged = {i: self._join(center, g) for i, g in groups.items() if i != c}
            ncps = {i: self._one(g) * g.n / rows for i, g in merged.items()}
            taken = None
            for p in self._partners(center, groups, c, ncps):
                if self.bound == "ncp":
                    if sum(loss.values()) + ncps[p] - loss[c] - loss[p] <= self.d:
                        taken = p
                        break
                else:
                    new = self._ul(merged[p])
                    if new <= uls[c] + uls[p]:
                        taken, uls[c] = p, new
                        break
                if self.order == "R":
                    break
            if taken is None:
                if self.bound == "ncp":
                    break
                continue
            groups[c], loss[c] = merged[taken], ncps[taken]
            for d in (groups, loss, uls, waiting):
                d.pop(taken, None)
            waiting[c] = loss[c]
            names[taken] = c
        return names

    def _partners(self, center: _Group, groups: dict[int, _Group], c: int, ncps: dict[int, float]) -> list[int]:
        if self.order == "R":
            return sorted(ncps, key=lambda i: (ncps[i], i))
        far = {i: btd_groups(center.baskets, groups[i].baskets) for i in ncps}
        if self.order == "T":
            return sorted(far, key=lambda i: (far[i], i))
        a, b = dense_ranks(ncps), dense_ranks(far)
        return sorted(ncps, key=lambda i: (a[i] + b[i], i))

    def merge_table(self, table: SerialTable, baskets: dict[int, Baskets] | None = None, support: np.ndarray | None = None) -> dict[int, int]:
        """The last name of each absorbed group, as :meth:`merge` has it, from arrays.

        Item losses come from ``support``, the rows of each group below each
        node, or else from ``baskets``.
        """
        whole = lambda x: (r := float(x).as_integer_ratio())[0] * (_ONE // r[1])
        total = sum(map(whole, table.loss.tolist()))  # of any precision, so that it stays right as losses come and go
        names: list[tuple[int, int]] = []
        h = self.h[self.schema.items]
        limit = self.d * (2**h.n_leaves - 1) * table.rows if self.bound == "ul" else self.d

        def ul(at: list[int]) -> int:
            """Item loss of some groups together."""
            if support is not None:
                return self._ul_of_support(support[at].sum(axis=0))
            together = baskets[at[0]]
            for i in at[1:]:
                together = together + baskets[i]
            return self._ul(_Group(0, {}, {}, {}, together))

        uls = [ul([i]) for i in range(len(table.id))] if self.bound == "ul" else []
        all_uls = sum(uls)
        waiting = list(zip(table.loss.tolist(), range(len(table.id))))
        heapify(waiting)
        while table.count > 1 and waiting:
            if self.bound == "ul" and (names or self.params.mode == "strict") and all_uls <= limit:
                break
            loss, c = heappop(waiting)
            if not table.alive[c] or loss != table.loss[c]:
                continue
            now = total / _ONE
            fits = lambda at: now + table.merged_loss(c, at) - table.loss[c] - table.loss[at] <= self.d  # noqa: B023, E731
            taken = far = None
            if self.bound == "ncp" and self.order == "T":
                taken, far = table.by_sets(c, fits) or (None, None)
            else:
                for p in [table.by_loss(c)] if self.order == "R" else table.by_sets_all(c) if self.order == "T" else table.by_ranks(c):
                    if self.bound == "ncp":
                        if fits(np.array([p]))[0]:
                            taken = p
                            break
                    elif (new := ul([c, p])) <= uls[c] + uls[p]:
                        taken = p
                        all_uls += new - uls[c] - uls[p]
                        uls[c], uls[p] = new, 0
                        break
            if taken is None:
                if self.bound == "ncp":
                    break
                continue
            total -= whole(table.loss[c]) + whole(table.loss[taken])
            table.join(c, taken, far)
            total += whole(table.loss[c])
            if support is not None:
                support[c] += support[taken]
            elif baskets is not None:
                baskets[c] = baskets[c] + baskets.pop(taken)
            heappush(waiting, (float(table.loss[c]), c))
            names.append((taken, c))
        last: dict[int, int] = {}
        for gone, into in reversed(names):
            last[gone] = last.get(into, into)  # as later merges are in already
        return {int(table.id[g]): int(table.id[c]) for g, c in last.items()}

    def _ul_of_support(self, support: np.ndarray) -> int:
        """Item loss of a group whose items are leaves, where single items need support, from its rows below each node."""
        h, k = self.h[self.schema.items], self.params.k
        there = np.flatnonzero(support)
        if not len(there) or support[there].min() >= k:
            return 0
        rows = Counter({(x,): n for x, n in zip(there.tolist(), support[there].tolist())})
        goes = {x: x for x in there.tolist() if h.is_leaf(x)}
        cut = self._cut
        for rule in cut._rules(rows, Counter(), 1):
            goes = {x: rule if y in cut.below[rule] else y for x, y in goes.items()}
        # what goes to a node is all that is there below it
        return sum(h.ul_weight(y) * rows[(y,)] for y in set(goes.values()))

    @cached_property
    def _cut(self) -> HierarchyCut:
        return HierarchyCut(self.h[self.schema.items], self.params.k, 1, self.params.mode)

    def __call__(self, encoded: DataFrame) -> DataFrame:
        """``encoded`` with merged ``group_id``."""
        groups = materialize(group_table(encoded, self.schema, self.h), "groups")
        data = arrays(groups.toPandas().sort_values("group_id"), self.schema, "group_id")
        blind = (self.order, self.bound) == ("R", "ncp")  # baskets decide nothing
        if blind and len(data["id"]) <= SERIAL_SCAN:
            return relabel(encoded, self.merge(self._groups(data)))
        ship(encoded.sparkSession)
        n_words = 0 if blind else (self.h[self.schema.items].size + 63) // 64
        words = [F.expr(f"aggregate(filter(items, x -> x div 64 = {w}), 0L, (bits, x) -> bits | shiftleft(1L, x % 64))").alias(f"w{w}") for w in range(n_words)]
        distinct = encoded.select("group_id", *words).groupBy("group_id", *[f"w{w}" for w in range(n_words)]).agg(F.count(F.lit(1)).alias("n"))
        names = materialize(distinct, "baskets").coalesce(1).mapInPandas(lambda batches: self._run(batches, data), "group_id long, new_id long")
        return relabel(encoded, {r["group_id"]: r["new_id"] for r in materialize(names, "names").collect()})

    def _groups(self, data: dict[str, np.ndarray]) -> dict[int, _Group]:
        """Groups without their baskets."""
        return {
            int(i): _Group(int(data["n_rows"][j]), {x: float(data[f"n_{x}_lo"][j]) for x in self.schema.numeric}, {x: float(data[f"n_{x}_hi"][j]) for x in self.schema.numeric}, {c: int(data[f"c_{c}"][j]) for c in self.schema.categorical}, Baskets([]))
            for j, i in enumerate(data["id"])
        }

    def _run(self, batches: Iterator[pd.DataFrame], data: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        """The merges of groups, whose distinct baskets are read here."""
        parts: list[np.ndarray] = [b.to_numpy(dtype=np.int64, copy=True) for b in batches]
        if not parts:
            return
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        if len(data["id"]) <= SERIAL_SCAN or not all(np.isfinite(v).all() for v in data.values()):
            groups = self._groups(data)
            for i, b in zip(data["id"].tolist(), self._baskets(rows, data["id"])):
                groups[i].baskets = b
            del rows
            names = self.merge(groups)
        else:
            names = self._run_table(rows, SerialTable(data, self.schema, self.h, self.domain))
        yield pd.DataFrame({"group_id": list(names), "new_id": list(names.values())}, dtype="int64")

    def _baskets(self, rows: np.ndarray, ids: np.ndarray) -> Iterator[Baskets]:
        """The baskets of each group from (group, bits, count) by group."""
        starts = np.searchsorted(rows[:, 0], ids)
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            yield Baskets([_Part(rows[a:b, 1:-1].T.copy().view(np.uint64), rows[a:b, -1].copy())])

    def _run_table(self, rows: np.ndarray, table: SerialTable) -> dict[int, int]:
        """The merges of many groups from their distinct baskets: (group, bits, count), by group."""
        group = np.searchsorted(table.id, rows[:, 0])
        bits, counts = rows[:, 1:-1].T.copy().view(np.uint64), rows[:, -1].copy()
        baskets = support = None
        if self.bound == "ul":
            h = self.h[self.schema.items]
            leaves = sum(1 << x for x in h.leaves())
            word = lambda items, w: np.uint64((items >> (64 * w)) & (2**64 - 1))
            if self.params.ul == "hierarchy" and self.params.m == 1 and not any((b & ~word(leaves, w)).any() for w, b in enumerate(bits)):
                support = np.zeros((len(table.id), h.size), dtype=np.int64)
                for x, below in enumerate(self._below):
                    hit = np.zeros(len(group), dtype=bool)
                    for w, b in enumerate(bits):
                        hit |= (b & word(below, w)) != 0
                    support[:, x] = np.bincount(group[hit], weights=counts[hit], minlength=len(table.id))
            else:
                baskets = dict(enumerate(self._baskets(rows, table.id)))
        if self.order != "R":
            table.read(group, bits, counts)
        del rows, bits, counts, group
        return self.merge_table(table, baskets, support)


VARIANTS = tuple(product(SerialMerger.ORDERS, SerialMerger.BOUNDS))
