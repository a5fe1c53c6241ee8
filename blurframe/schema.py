"""Schema and parameters of a table that mixes relational columns with one set-valued column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

KINDS = {"n": "numeric", "c": "categorical", "t": "transaction"}


class SchemaError(ValueError):
    """A schema, hierarchy or parameter that cannot be used."""


@dataclass(frozen=True)
class RTSchema:
    """Columns in order with their kinds: ``n`` numeric, ``c`` categorical, ``t`` the one set of items.

    ``weights`` are keyed by column name, so their meaning does not depend on
    the order of columns.
    """

    columns: tuple[tuple[str, str], ...]
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        names = [n for n, _ in self.columns]
        if len(set(names)) != len(names):
            raise SchemaError(f"repeated column names in {names}")
        bad = [k for _, k in self.columns if k not in KINDS]
        if bad:
            raise SchemaError(f"unknown kinds {bad}; known are {sorted(KINDS)}")
        if sum(k == "t" for _, k in self.columns) != 1:
            raise SchemaError("exactly one column of kind t is needed")
        unknown = set(self.weights) - set(self.numeric) - set(self.categorical)
        if unknown:
            raise SchemaError(f"weights for unknown columns {sorted(unknown)}")

    @classmethod
    def from_header(cls, header: str) -> RTSchema:
        """From ``name#kind,name#kind,...``; the header's separator is always a comma."""
        pairs = []
        for part in header.strip().split(","):
            name, mark, kind = part.strip().rpartition("#")
            if not mark or not name:
                raise SchemaError(f"header part {part!r} is not name#kind")
            pairs.append((name, kind))
        return cls(tuple(pairs))

    @classmethod
    def from_order(cls, kinds: str | list[str], weights: dict[str, float] | None = None) -> RTSchema:
        """For files without a header: columns are named by kind and place (n0, c1, ...)."""
        return cls(tuple((f"{k}{i}", k) for i, k in enumerate(kinds)), weights or {})

    @property
    def numeric(self) -> list[str]:
        return [n for n, k in self.columns if k == "n"]

    @property
    def categorical(self) -> list[str]:
        return [n for n, k in self.columns if k == "c"]

    @property
    def items(self) -> str:
        return next(n for n, k in self.columns if k == "t")

    @property
    def n_relational(self) -> int:
        """Relational attributes, the set of items not counted."""
        return len(self.columns) - 1

    def weight(self, name: str) -> float:
        return self.weights.get(name, 1.0)


@dataclass(frozen=True)
class Params:
    """Parameters of an anonymization.

    ``rd`` and ``td`` are shares in [0, 1] of the largest possible relational
    and item loss; :meth:`scaled` turns them into totals for a given number of
    rows, in one step and without changing this object.
    """

    k: int = 10
    m: int = 2
    rd: float = 1.0
    td: float = 0.0
    ul: str = "hierarchy"
    max_clusters: int = 1000
    max_merges: int = 1000
    min_tree: int = 1
    max_tree: int = 5
    max_conflicts: int | None = None
    mode: str = "reference"

    def __post_init__(self):
        if self.k < 1 or self.m < 1:
            raise SchemaError("k and m must be at least 1")
        if self.ul not in ("hierarchy", "pcta"):
            raise SchemaError("ul must be 'hierarchy' or 'pcta'")
        if self.mode not in ("reference", "strict"):
            raise SchemaError("mode must be 'reference' or 'strict'")
        if not (0 <= self.rd <= 1 and 0 <= self.td <= 1):
            raise SchemaError("rd and td must lie in [0, 1]")
        if self.max_clusters < 1 or self.max_merges < 1 or not 1 <= self.min_tree <= self.max_tree:
            raise SchemaError("max_clusters and max_merges must be at least 1, and 1 <= min_tree <= max_tree")

    @property
    def conflicts(self) -> int:
        return self.k // 2 if self.max_conflicts is None else self.max_conflicts

    def scaled(self, n_rows: int, n_relational: int, item_leaves: int) -> tuple[float, int]:
        """(largest relational loss, largest item loss) in totals over all rows."""
        from fractions import Fraction

        return self.rd * n_rows * n_relational, int(Fraction(str(self.td)) * (2**item_leaves - 1) * n_rows)

    def with_(self, **changes) -> Params:
        return replace(self, **changes)
