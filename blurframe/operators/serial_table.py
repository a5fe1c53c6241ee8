"""Many groups of serial merging as arrays, for searches of partners that look at what decides only.

Groups stand by ascending id and are meant by their places. The distance of two
groups is that of their two rows that lie farthest apart. A few of each
group's largest item sets give it nearly always: what all other pairs could
reach at most, without a common item, is no more. Where it may be, all rows
that reach beyond it are compared, so results equal those of a full comparison.
"""

from __future__ import annotations

import numpy as np

from ..hierarchy import Hierarchy
from ..schema import RTSchema

#: Largest item sets of a group that are compared first.
_TOP = 8
#: Pairs of sets that are compared at once.
_PAIRS = 1 << 20


def distance(s, t, common=0):
    """Distance of sets of s and t items with so many in common."""
    return (s + t - 2 * common + 1) * (s + t - common) / (common + 1)


def _count(bits: np.ndarray) -> np.ndarray:
    """Items of sets, whose words are the first axis."""
    return np.bitwise_count(bits[0]).astype(np.int64) if len(bits) == 1 else np.bitwise_count(bits).sum(axis=0, dtype=np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """The same sets with bits for items that occur only."""
    used = [(w, x) for w, word in enumerate(np.bitwise_or.reduce(bits, axis=1).tolist()) for x in range(64) if word >> x & 1]
    if len(used) > 64 * (len(bits) - 1) or len(bits) < 2:
        return bits
    out = np.zeros((max(1, (len(used) + 63) // 64), bits.shape[1]), dtype=np.uint64)
    for i, (w, x) in enumerate(used):
        out[i // 64] |= (bits[w] >> np.uint64(x) & np.uint64(1)) << np.uint64(i % 64)
    return out


def ancestors(hierarchy: Hierarchy) -> np.ndarray:
    """(node, node): the lowest common ancestor."""
    out = np.full((hierarchy.size, hierarchy.size), hierarchy.root)
    for node in range(hierarchy.size):  # deeper subtrees overwrite what their ancestors set
        inside = np.array([node, *hierarchy.crawl_down(node)])
        out[np.ix_(inside, inside)] = node
    return out


class SerialTable:
    """``data`` are arrays by ascending id; the loss of a group is weighted and over all rows."""

    def __init__(self, data: dict[str, np.ndarray], schema: RTSchema, hierarchies: dict[str, Hierarchy], domain: dict[str, float]):
        self.id, self.n = data["id"], data["n_rows"].copy()
        self.rows = int(self.n.sum())
        self.together = {c: ancestors(hierarchies[c]) for c in schema.categorical}
        self.costs = {}
        for c in schema.categorical:
            h = hierarchies[c]
            self.costs[c] = np.array([h.leaf_frac(i) * schema.weight(c) if h.leaf_counts[i] > 1 else 0.0 for i in range(h.size)])[self.together[c]]
        self.cat = {c: data[f"c_{c}"].copy() for c in schema.categorical}
        self.lo, self.hi = ({x: data[f"n_{x}_{end}"].copy() for x in schema.numeric} for end in ("lo", "hi"))
        self.widths = [(x, domain[x], schema.weight(x)) for x in schema.numeric if domain[x] > 0]
        self.alive, self.count = np.ones(len(self.id), dtype=bool), len(self.id)
        self.places, self.members = np.arange(len(self.id)), {}
        one = np.zeros(len(self.id))
        for c, cost in self.costs.items():
            one += cost[self.cat[c], self.cat[c]]
        for x, width, weight in self.widths:
            one += (self.hi[x] - self.lo[x]) / width * weight
        self.loss = one * self.n / self.rows

    # item sets ------------------------------------------------------------------------------

    def read(self, group: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> None:
        """Takes the item sets of places ``group``: a row of ``bits`` for 64 items each, a column a set."""
        bits = _packed(bits)
        size = _count(bits)
        order = np.lexsort((-size, group))
        order = np.repeat(order, np.minimum(counts[order], 2))  # a set that occurs twice is its own partner
        self.bits, self.sizes = bits[:, order], size[order].astype(np.int32)
        self.start = np.searchsorted(group[order], np.arange(len(self.id) + 1))
        del order, size
        own = np.diff(self.start)
        at = self.start[:-1, None] + np.minimum(np.arange(_TOP)[None, :], own[:, None] - 1)
        self.top, self.top_size = self.bits[:, at], self.sizes[at].astype(np.int64)
        self.held = np.minimum(own, _TOP)  # sets that stand in top, which repeats the last one
        self.next = np.where(own > _TOP, self.sizes[np.minimum(self.start[:-1] + _TOP, len(self.sizes) - 1)], -1).astype(np.int64)
        self.within = np.zeros(len(self.id))
        for b in range(1, _TOP):
            for a in range(b):
                new = distance(self.top_size[:, a], self.top_size[:, b], _count(self.top[:, :, a] & self.top[:, :, b]))
                self.within = np.where(own > b, np.maximum(self.within, new), self.within)
        for g in np.flatnonzero((self.next >= 0) & (self.within < distance(self.top_size[:, 0], self.next))).tolist():
            rows = np.arange(self.start[g], self.start[g + 1])
            self.within[g] = self._farthest(rows, rows, self.within[g], True)

    def _farthest(self, a: np.ndarray, b: np.ndarray, most: float, same: bool = False) -> float:
        """The largest distance of one of the sets ``a`` and one of ``b``, or ``most``; with ``same``, b is a and no set is its own partner."""
        step = max(1, _PAIRS // len(b))
        for i in range(0, len(a), step):
            part = a[i : i + step]
            common = _count(self.bits[:, part, None] & self.bits[:, None, b])
            far = distance(self.sizes[part].astype(np.int64)[:, None], self.sizes[b].astype(np.int64)[None, :], common)
            if same:
                far[np.arange(len(part)), np.arange(i, i + len(part))] = 0.0
            most = max(most, float(far.max()))
        return most

    def _sets(self, g: int, reach: int, most: float) -> np.ndarray:
        """The sets of group ``g`` that may be farther than ``most`` from one of ``reach`` items."""
        parts = self.members.get(g)
        if parts is None:
            rows = np.arange(self.start[g], self.start[g + 1])
        elif len(parts) == 1:
            rows = parts[0]
        else:
            rows = np.concatenate(parts)
            rows = rows[np.argsort(-self.sizes[rows], kind="stable")]
            self.members[g] = [rows]
        # the largest come first
        enough = np.flatnonzero(distance(np.arange(self.sizes[rows[0]] + 1), reach) > most)
        return rows[: np.searchsorted(-self.sizes[rows], -enough[0], "right")] if len(enough) else rows[:0]

    def far(self, c: int, at: np.ndarray, most_asked: float = np.inf) -> np.ndarray:
        """The largest distance of two rows of group ``c`` and each of ``at`` together; beyond ``most_asked`` it may be larger than told."""
        out = np.maximum(self.within[at], self.within[c])
        s, t = int(self.top_size[c, 0]), self.top_size[at, 0]
        most = distance(s, t)
        todo = np.flatnonzero(most > out)
        if not len(todo):
            return out
        apart = (self.top[:, at[todo], 0] & self.top[:, c, 0][:, None] == 0).all(axis=0)
        out[todo[apart]] = most[todo[apart]]
        todo = todo[~apart]
        for i in range(0, len(todo), _PAIRS // _TOP**2):
            part = todo[i : i + _PAIRS // _TOP**2]
            g = at[part]
            common = _count(self.top[:, g, :, None] & self.top[:, c][:, None, None, :])
            new = distance(self.top_size[g][:, :, None], self.top_size[c][None, None, :], common).max(axis=(1, 2))
            out[part] = np.maximum(out[part], new)
            rest = np.where(self.next[g] >= 0, distance(s, self.next[g]), -1.0)
            if self.next[c] >= 0:
                rest = np.maximum(rest, distance(int(self.next[c]), t[part]))
            for j in part[(rest > out[part]) & (out[part] <= most_asked)].tolist():
                a, b = self._sets(c, int(t[j]), out[j]), self._sets(int(at[j]), s, out[j])
                if len(a) and len(b):
                    out[j] = self._farthest(a, b, out[j])
        return out

    # relational loss ------------------------------------------------------------------------

    def merged_loss(self, c: int, at: np.ndarray) -> np.ndarray:
        """The loss of group ``c`` merged with each of ``at``."""
        one = np.zeros(len(at))
        for x, cost in self.costs.items():
            one += cost[self.cat[x][c]][self.cat[x][at]]
        for x, width, weight in self.widths:
            one += (np.maximum(self.hi[x][at], self.hi[x][c]) - np.minimum(self.lo[x][at], self.lo[x][c])) / width * weight
        return one * (self.n[at] + self.n[c]) / self.rows

    # merging --------------------------------------------------------------------------------

    def others(self, c: int) -> np.ndarray:
        """All groups but ``c``."""
        at = self.places[self.alive[self.places]] if self.count < len(self.places) else self.places
        return np.delete(at, np.searchsorted(at, c))

    def join(self, c: int, p: int, far: float | None = None) -> None:
        """Group ``c`` takes in ``p``, at the distance ``far`` if that is known."""
        pair = np.array([p])
        loss = self.merged_loss(c, pair)[0]
        if hasattr(self, "within"):
            self.within[c] = self.far(c, pair)[0] if far is None else far
            sizes, sets = np.concatenate([self.top_size[c], self.top_size[p]]), np.concatenate([self.top[:, c], self.top[:, p]], axis=1)
            real = np.concatenate([np.arange(_TOP) < self.held[c], np.arange(_TOP) < self.held[p]])
            order = np.argsort(np.where(real, -sizes, 1), kind="stable")
            many = int(real.sum())
            keep = order[np.minimum(np.arange(_TOP), many - 1)]
            self.next[c] = max(self.next[c], self.next[p], sizes[order[_TOP]] if many > _TOP else -1)
            self.top[:, c], self.top_size[c] = sets[:, keep], sizes[keep]
            self.held[c] = min(many, _TOP)
            mine, more = (self.members.pop(g, None) or [np.arange(self.start[g], self.start[g + 1])] for g in (c, p))
            if len(mine) < len(more):
                mine, more = more, mine
            mine.extend(more)
            self.members[c] = mine
        for x, table in self.together.items():
            self.cat[x][c] = table[self.cat[x][c], self.cat[x][p]]
        for x in self.lo:
            self.lo[x][c], self.hi[x][c] = min(self.lo[x][c], self.lo[x][p]), max(self.hi[x][c], self.hi[x][p])
        self.n[c] += self.n[p]
        self.loss[c] = loss
        self.alive[p] = False
        self.count -= 1
        if self.count < len(self.places) * 7 // 8:
            self.places = self.places[self.alive[self.places]]

    # partners, best first -------------------------------------------------------------------

    def by_sets(self, c: int, fits) -> tuple[int, float] | None:
        """The group at the least distance from ``c``, then of the least id, among those that ``fits`` marks; with the distance."""
        own, a, many = self.within[c], 0, 64
        places = self.places
        while a < len(places):  # none is nearer than the rows of c are to each other
            at = places[a : a + many]
            at = at[self.alive[at] & (self.within[at] <= own) & (at != c)]
            a, many = a + many, 2 * many
            for i in range(0, len(at), 32) if many < 1024 else (0,):
                near = at[i : i + 32] if many < 1024 else at
                if len(near) and len(near := near[self.far(c, near, own) <= own]) and len(near := near[fits(near)]):
                    return int(near[0]), own
        at = self.others(c)
        at = at[fits(at)]
        if not len(at):
            return None
        some = at
        if len(at) > 2048:  # none is nearer than its own rows are to each other
            some = at[self.within[at] <= np.partition(self.within[at], 1024)[1024]]
            least = float(self.far(c, some).min())
            some = at[self.within[at] <= least]
        far = self.far(c, some)
        return int(some[far.argmin()]), float(far.min())

    def by_sets_all(self, c: int):
        """All other groups by distance, then by id."""
        at = self.others(c)
        first = self.by_sets(c, lambda some: np.ones(len(some), dtype=bool))
        yield first[0]
        yield from at[np.argsort(self.far(c, at), kind="stable")].tolist()

    def by_ranks(self, c: int):
        """All other groups by the sum of their places in loss and in distance, then by id."""
        at = self.others(c)
        loss, far = self.merged_loss(c, at), self.far(c, at)
        steps = np.unique(far) if len(far) < 5000 else _distinct(far)
        place = np.searchsorted(steps, far) + 1
        # the least loss has place 1 and at most len(steps), so the best is among as many least losses
        some, most = np.arange(len(at)), 4 * len(steps) + 16
        if len(at) > 2 * most:
            some = np.flatnonzero(loss <= np.partition(loss, most)[most])
        low, rank = np.unique(loss[some], return_inverse=True)
        if len(low) >= len(steps) or len(some) == len(at):
            yield int(at[some[(rank + 1 + place[some]).argmin()]])
        rank = np.unique(loss, return_inverse=True)[1]
        yield from at[np.argsort(rank + 1 + place, kind="stable")].tolist()

    def by_loss(self, c: int) -> int:
        """The group that merges with ``c`` at the least loss, then of the least id."""
        at = self.others(c)
        return int(at[self.merged_loss(c, at).argmin()])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, of which there are few."""
    out, rest = [], values
    while len(rest):
        found = np.unique(rest[:1000])
        out.append(found)
        rest = rest[found[np.minimum(np.searchsorted(found, rest), len(found) - 1)] != rest]
    return np.sort(np.concatenate(out))
