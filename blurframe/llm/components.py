"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that is not a root itself; root is the smallest node reachable.

    Alternates two contractions until nothing changes: every node hangs its
    larger neighbours on the smallest node it sees, then its smaller ones.
    The number of rounds grows with the logarithm of the longest chain. Each
    round is written to the shared folder, so lost executors cost one round at
    most, and only a count and a checksum come to the driver. A hub's edges are
    reduced with partial minima and joined with a skew-aware join.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        following = materialize(small.distinct(), label)
        drop_scratch(large)
        drop_scratch(now)
        now, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge leads to a root
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
