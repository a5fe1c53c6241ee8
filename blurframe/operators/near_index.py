"""Nearest rows or groups within one task, exactly, without looking at all of them.

Rows stand in cells of equal categorical values and, within a cell, in the
order of their first numeric column. A search takes what may be nearest first:
the categorical cost of a cell, and with it the interval up to the next row on
either side, are lower bounds of all that was not looked at. It ends when its
last hit is below all of them. Costs are those of ``PairCost``, number for
number, and ties go to the smaller id, so results equal those of a full scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, ship
from ..schema import RTSchema
from .generalize import relational_columns
from .neighbors import PairCost, arrays

#: Cells whose order of other cells is kept.
_KEPT = 2000
#: Combinations of categorical values, there or not, that may be numbered by a table.
_CODES = 1 << 16
#: Rows of a batch of results.
_OUT = 500_000


def searchable(rows: dict[str, np.ndarray], cost: PairCost) -> bool:
    """Whether the bounds hold: no numeric value is missing or unbounded."""
    return all(np.isfinite(rows[f"n_{x}_{end}"]).all() for x in cost.schema.numeric for end in ("lo", "hi"))


def bounded(rows: DataFrame, schema: RTSchema) -> bool:
    """The same of a frame."""
    most = np.finfo(float).max
    ok = F.lit(True)
    for c in relational_columns(schema):
        if c.startswith("n_"):
            ok = ok & F.coalesce(F.col(c).between(-most, most), F.lit(False))
    return rows.where(~ok).isEmpty()


class CellIndex:
    """``rows`` are arrays by ascending id; rows are meant by their places in them."""

    def __init__(self, rows: dict[str, np.ndarray], cost: PairCost):
        self.rows, self.cost, n = rows, cost, len(rows["id"])
        self.cats, self.nums = [f"c_{c}" for c in cost.schema.categorical], [x for x in cost.schema.numeric if cost.domain[x] > 0]
        code, most = np.zeros(n, dtype=np.int64), 1
        for c in cost.schema.categorical:
            size = cost.tables[c].shape[0]
            if most * size >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                most = n
            code, most = code * size + rows[f"c_{c}"], most * size
        if most <= _CODES:  # no sort is needed
            there = np.flatnonzero(np.bincount(code, minlength=most))
            first, number = np.empty(most, dtype=np.int64), np.empty(most, dtype=np.int64)
            first[code], number[there] = np.arange(n), np.arange(len(there))
            first, cell = first[there], number[code]
        else:
            _, first, cell = np.unique(code, return_index=True, return_inverse=True)
        del code
        self.cell, self.values = cell.astype(np.int16 if len(first) < 1 << 15 else np.int32), {c: rows[c][first] for c in self.cats}
        x = rows[f"n_{self.nums[0]}_lo"] if self.nums else np.zeros(n)
        self.order = np.lexsort((x, self.cell)).astype(np.int32 if n < 1 << 31 else np.int64)  # stable, so equal rows stay by id
        self.x = x[self.order]
        self.start = np.searchsorted(self.cell[self.order], np.arange(len(first) + 1))
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(n)
        self.alive, self.n, self.levels = np.ones(n, dtype=bool), n, {}

    def remove(self, at: np.ndarray) -> None:
        """Rows that no search finds from now on."""
        self.alive[self.place[at]] = False
        self.n -= len(at)
        if len(self.order) > 1000 and self.n < len(self.order) * 7 // 8:
            before = np.concatenate([[0], np.cumsum(self.alive)])
            self.order, self.x, self.start = self.order[self.alive], self.x[self.alive], before[self.start]
            self.place[self.order] = np.arange(len(self.order))
            self.alive = np.ones(len(self.order), dtype=bool)

    def _levels(self, cell: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Categorical costs from a cell, ascending, and the cells of each."""
        if cell in self.levels:
            return self.levels[cell]
        costs = np.zeros(len(self.start) - 1)
        for c in self.cats:
            costs += self.cost.tables[c[2:]][self.values[c], self.values[c][cell]]
        steps, of = np.unique(costs, return_inverse=True)
        out = steps, np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
        if len(self.start) <= _KEPT:
            self.levels[cell] = out
        return out

    def nearest(self, i: int, k: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, costs): the ``k`` nearest to row ``i``, itself included, by cost and id.

        ``value`` makes what is minimised from rows and their costs; it is no
        less than ``scale`` times the cost.
        """
        steps, cells = self._levels(int(self.cell[i]))
        ends = [(self.cost.domain[x], self.rows[f"n_{x}_lo"], self.rows[f"n_{x}_hi"]) for x in self.nums]
        width = ends[0][0] if ends else 1.0
        low, high = (float(ends[0][1][i]), float(ends[0][2][i])) if ends else (0.0, 0.0)
        found, costs = np.zeros(0, dtype=np.int64), np.zeros(0)
        todo: list[tuple] = [(steps[0] * scale, 0, 0, 0, 0, 0.0, 0)]  # bound, kind (0 opens a level), place, cell's end, number of rows, categorical cost, level

        def take(a: int, b: int, base: float) -> None:
            nonlocal found, costs
            at = self.order[a:b][self.alive[a:b]]
            if not len(at):
                return
            new = np.full(len(at), base)
            for w, lo, hi in ends:
                wide = np.maximum(hi[at], hi[i]) - np.minimum(lo[at], lo[i])
                new += np.where(wide > 0, wide / w, 0.0)
            if value is not None:
                new = value(at, new)
            found, costs = np.concatenate([found, at]), np.concatenate([costs, new])
            if len(found) > k:
                best = np.lexsort((found, costs))[:k]
                found, costs = found[best], costs[best]

        def ahead(kind: int, place: int, end: int, many: int, base: float) -> None:
            """What lies beyond ``place`` on the left (1) or right (2), if anything."""
            if (place > end) if kind == 1 else (place < end):
                gap = (high - self.x[place - 1]) if kind == 1 else (max(self.x[place], high) - low)
                heapq.heappush(todo, ((base + max(gap, 0.0) / width if ends else base) * scale, kind, int(place), int(end), many, base, 0))

        while todo:
            bound, kind, place, end, many, base, level = heapq.heappop(todo)
            if len(found) >= k and costs.max() < bound:
                break
            if kind == 0:
                if level + 1 < len(steps):
                    heapq.heappush(todo, (steps[level + 1] * scale, 0, 0, 0, 0, 0.0, level + 1))
                for c in cells[level]:
                    a, b = int(self.start[c]), int(self.start[c + 1])
                    if a < b:
                        p = a + int(np.searchsorted(self.x[a:b], low))
                        left, right = max(a, p - k), min(b, p + k)
                        take(left, right, float(steps[level]))
                        ahead(1, left, a, 2 * k, float(steps[level]))
                        ahead(2, right, b, 2 * k, float(steps[level]))
            elif kind == 1:
                to = max(end, place - many)
                take(to, place, base)
                ahead(1, to, end, 2 * many, base)
            else:
                to = min(end, place + many)
                take(place, to, base)
                ahead(2, to, end, 2 * many, base)
        best = np.lexsort((found, costs))
        return found[best], costs[best]


def in_one_task(rows: DataFrame, schema: RTSchema, id_column: str, work: Callable[[dict[str, np.ndarray]], Iterator[pd.DataFrame]], out: str, label: str) -> DataFrame:
    """What ``work`` makes of all rows, as arrays by ascending id, in one task; written to the shared folder."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for b in batches:
            new = arrays(b, schema, id_column)
            part = {c: v.astype(np.min_scalar_type(-1 - int(v.max(initial=0)))) if c.startswith("c_") else v.copy() for c, v in new.items() if not c.endswith("_hi")}
            for x in schema.numeric:  # most rows are points, which are held once
                lo, hi = part[f"n_{x}_lo"], new[f"n_{x}_hi"]
                part[f"n_{x}_hi"] = lo if np.array_equal(lo, hi) else hi.copy()
            parts.append(part)
        if not parts:
            return
        by_id = np.argsort(np.concatenate([p["id"] for p in parts]), kind="stable")
        points = [x for x in schema.numeric if all(p[f"n_{x}_lo"] is p[f"n_{x}_hi"] for p in parts)]
        for p in parts:
            for x in points:
                del p[f"n_{x}_hi"]
        data = {}
        for c in list(parts[0]):
            data[c] = np.concatenate([p.pop(c) for p in parts])[by_id]
        del by_id
        for x in points:
            data[f"n_{x}_hi"] = data[f"n_{x}_lo"]
        yield from work(data)

    columns = [id_column, *relational_columns(schema), *(c for c in ("n_rows", "ncp") if c in rows.columns)]
    return materialize(rows.select(*columns).coalesce(1).mapInPandas(run, out), label)


def batches(columns: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Results in parts of bounded size."""
    n = len(next(iter(columns.values())))
    for a in range(0, n, _OUT):
        yield pd.DataFrame({c: v[a : a + _OUT] for c, v in columns.items()})
