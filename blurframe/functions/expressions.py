"""Column expressions of the engine. All run inside code generation or built-in array functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "btd",
    "gain",
    "hull_high",
    "hull_low",
    "interval_share",
    "interval_text",
    "lca_of_levels",
    "lca_of_paths",
    "level_min_max",
    "ncp_ul_ratio",
    "node_of_level",
    "related_paths",
    "strict_ancestors",
]


# hierarchies ------------------------------------------------------------------------


def lca_of_paths(a: Column, b: Column) -> Column:
    """Lowest common ancestor of two nodes, from their paths (root first)."""
    return F.element_at(F.array_intersect(a, b), -1)


def related_paths(path_a: Column, a: Column, path_b: Column, b: Column) -> Column:
    """Whether one node is the other or an ancestor of it."""
    return F.array_contains(path_a, b) | F.array_contains(path_b, a)


def strict_ancestors(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(path) - 1)


def node_of_level(level: Column) -> Column:
    """The node behind a level value; padding below a shallow node is -1 - id."""
    return F.when(level < 0, -1 - level).otherwise(level)


def level_min_max(prefix: str, height: int) -> list[Column]:
    """Aggregates from which :func:`lca_of_levels` finds a group's lowest common ancestor."""
    out = []
    for i in range(height + 1):
        out += [F.min(f"{prefix}l{i}").alias(f"{prefix}lo{i}"), F.max(f"{prefix}l{i}").alias(f"{prefix}hi{i}")]
    return out


def lca_of_levels(prefix: str, height: int) -> Column:
    """The deepest level on which a group agrees. Integer minima and maxima keep the aggregation hash-based."""
    tests = [F.when(F.col(f"{prefix}lo{i}") == F.col(f"{prefix}hi{i}"), node_of_level(F.col(f"{prefix}lo{i}"))) for i in range(height, -1, -1)]
    return F.coalesce(*tests)


# intervals --------------------------------------------------------------------------


def hull_low(*lows: Column) -> Column:
    return F.least(*lows) if len(lows) > 1 else lows[0]


def hull_high(*highs: Column) -> Column:
    return F.greatest(*highs) if len(highs) > 1 else highs[0]


def interval_share(low: Column, high: Column, domain: float) -> Column:
    """Width of an interval as a share of the domain; 0 for a point, also where the domain is a point."""
    if domain <= 0:
        return F.lit(0.0)
    return F.when(high > low, (high - low) / F.lit(float(domain))).otherwise(F.lit(0.0))


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def interval_text(low: Column, high: Column) -> Column:
    """``x`` for a point and ``lo-hi`` else; whole numbers without a fraction."""
    return F.when(low == high, _number(low)).otherwise(F.concat_ws("-", _number(low), _number(high)))


# sets -------------------------------------------------------------------------------


def btd(a: Column, b: Column) -> Column:
    """Distance of two item sets: (|a xor b| + 1) |a or b| / (|a and b| + 1)."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return (either - both + 1) * either / (both + 1)


# loss -------------------------------------------------------------------------------


def ncp_ul_ratio(ncp: Column, ul: Column) -> Column:
    """Relational loss per item loss; 1e11 where no items are lost."""
    return F.when(ul == 0, F.lit(1e11)).otherwise(ncp / ul.cast("double"))


def gain(ul_diff: Column, ncp_diff: Column, mode: str = "reference") -> Column:
    """Change of item loss per change of relational loss; lower is better.

    A merge that costs no relational loss comes last (1e11) in reference mode
    and first (-1e11) in strict mode.
    """
    free = F.lit(1e11 if mode == "reference" else -1e11)
    return F.when(ncp_diff == 0, free).otherwise(ul_diff.cast("double") / ncp_diff)


def total(columns: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out
