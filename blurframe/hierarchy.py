"""Value hierarchies: one rooted tree per categorical column and one for the items.

A hierarchy is a small dimension. It is built once on the driver and joined as
a table of nodes; rows only carry node ids. Ids go by depth and then by label,
so they do not depend on the order of a file.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import SchemaError

#: Leaves up to which item losses are summed as decimal(38,0); beyond it they are finished from a histogram.
DECIMAL_LEAVES = 100


class Hierarchy:
    """A rooted tree over labels.

    Leaves cost nothing: ``leaf_cnt``, ``leaf_frac`` and ``ul_weight`` of a leaf
    are 0. An inner node over u leaves of L has leaf_cnt u, leaf_frac u / L and
    ul_weight 2^u - 1.
    """

    def __init__(self, edges: Iterable[tuple[str, str]], name: str = ""):
        self.name = name
        parent: dict[str, str] = {}
        labels: dict[str, None] = {}
        for up, down in edges:
            labels.setdefault(up)
            labels.setdefault(down)
            parent[down] = up  # a later parent replaces an earlier one
        if not labels:
            raise SchemaError(f"hierarchy {name!r} is empty")
        roots = [x for x in labels if x not in parent]
        if len(roots) != 1:
            raise SchemaError(f"hierarchy {name!r} needs exactly one root, found {sorted(roots)[:5]}")
        depth = {roots[0]: 0}
        for x in labels:
            way = []
            while x not in depth:
                way.append(x)
                x = parent[x]
                if x in way:
                    raise SchemaError(f"hierarchy {name!r} has a cycle at {x!r}")
            for y in reversed(way):
                depth[y] = depth[parent[y]] + 1
        order = sorted(labels, key=lambda x: (depth[x], x))
        self.labels = order
        self.ids = {x: i for i, x in enumerate(order)}
        self.parents = [self.ids[parent[x]] if x in parent else None for x in order]
        self.depths = [depth[x] for x in order]
        self.kids: dict[int, list[int]] = defaultdict(list)
        for i, up in enumerate(self.parents):
            if up is not None:
                self.kids[up].append(i)
        below = [0] * len(order)
        for i in reversed(range(len(order))):
            below[i] = sum(below[c] for c in self.kids[i]) if self.kids.get(i) else 1
        self.n_leaves = below[0]
        self.leaf_counts = [below[i] if self.kids.get(i) else 0 for i in range(len(order))]

    # construction -----------------------------------------------------------------

    @classmethod
    def from_lines(cls, lines: Iterable[str], name: str = "") -> Hierarchy:
        """From ``parent:child1,child2,...`` per inner node."""
        edges = []
        for line in lines:
            if not line.strip():
                continue
            up, mark, down = line.strip().partition(":")
            if not mark:
                raise SchemaError(f"hierarchy line {line!r} is not parent:children")
            edges += [(up.strip(), x.strip()) for x in down.split(",") if x.strip()]
        return cls(edges, name)

    @classmethod
    def from_frame(cls, df: DataFrame, name: str = "") -> Hierarchy:
        """From the distinct edges of ``df(parent, child)``, a table as small as the hierarchy."""
        return cls(((r["parent"], r["child"]) for r in df.select("parent", "child").distinct().collect()), name)

    # nodes ------------------------------------------------------------------------

    @property
    def size(self) -> int:
        return len(self.labels)

    @property
    def root(self) -> int:
        return 0

    @cached_property
    def height(self) -> int:
        return max(self.depths)

    def depth(self, node: int) -> int:
        return self.depths[node]

    def parent(self, node: int) -> int | None:
        return self.parents[node]

    def children(self, node: int) -> list[int]:
        return list(self.kids.get(node, ()))

    def is_leaf(self, node: int) -> bool:
        return not self.kids.get(node)

    def leaf_frac(self, node: int) -> float:
        return self.leaf_counts[node] / self.n_leaves

    def ul_weight(self, node: int) -> int:
        return 2 ** self.leaf_counts[node] - 1

    def path(self, node: int) -> list[int]:
        """From the root to the node, both included."""
        out = [node]
        while (up := self.parents[out[-1]]) is not None:
            out.append(up)
        return out[::-1]

    def crawl_up(self, node: int) -> list[int]:
        """The node's ancestors, from the root down."""
        return self.path(node)[:-1]

    def crawl_down(self, node: int, leaves_only: bool = False) -> list[int]:
        """The node's descendants, or only the leaves among them."""
        out, todo = [], self.children(node)
        while todo:
            x = todo.pop()
            todo += self.children(x)
            if not leaves_only or self.is_leaf(x):
                out.append(x)
        return sorted(out)

    def leaves(self, node: int | None = None) -> list[int]:
        if node is None:
            return [i for i in range(self.size) if self.is_leaf(i)]
        return [node] if self.is_leaf(node) else self.crawl_down(node, leaves_only=True)

    def inner_nodes(self) -> list[int]:
        return [i for i in range(self.size) if not self.is_leaf(i)]

    def lca(self, a: int, b: int) -> int:
        last = self.root
        for x, y in zip(self.path(a), self.path(b)):
            if x != y:
                break
            last = x
        return last

    def related(self, a: int, b: int) -> bool:
        """Whether one is the other or an ancestor of it."""
        return self.lca(a, b) in (a, b)

    def cut(self, node: int) -> tuple[list[int], int] | None:
        """The rule that replaces all descendants by the node; none for a leaf."""
        return None if self.is_leaf(node) else (self.crawl_down(node), node)

    # tables -----------------------------------------------------------------------

    def levels(self, node: int) -> list[int]:
        """Ids from the root down to the tree's height; below the node its own id, tagged as -1 - id."""
        path = self.path(node)
        return path + [-1 - node] * (self.height + 1 - len(path))

    def rows(self) -> list[tuple]:
        return [
            (self.name, i, x, self.parents[i], self.depths[i], self.leaf_counts[i], self.leaf_frac(i), str(self.ul_weight(i)) if self.leaf_counts[i] <= 126 else None, self.path(i), *self.levels(i))
            for i, x in enumerate(self.labels)
        ]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(attr, node, label, parent, depth, leaf_cnt, leaf_frac, ul_weight, path, l0, l1, ...)."""
        fields = [
            T.StructField("attr", T.StringType()),
            T.StructField("node", T.IntegerType()),
            T.StructField("label", T.StringType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("leaf_cnt", T.IntegerType()),
            T.StructField("leaf_frac", T.DoubleType()),
            T.StructField("ul_weight", T.StringType()),
            T.StructField("path", T.ArrayType(T.IntegerType())),
            *[T.StructField(f"l{i}", T.IntegerType()) for i in range(self.height + 1)],
        ]
        df = spark.createDataFrame(self.rows(), T.StructType(fields))
        return df.withColumn("ul_weight", F.col("ul_weight").cast("decimal(38,0)"))

    def closure(self, spark: SparkSession) -> DataFrame:
        """(ancestor, node, distance), each node with itself included."""
        rows = [(up, i, self.depths[i] - self.depths[up]) for i in range(self.size) for up in self.path(i)]
        return spark.createDataFrame(rows, "ancestor int, node int, distance int")
