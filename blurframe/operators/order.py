"""Places and ranks in a sorted table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize, n_shuffle


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of the columns ``order``, which tell all rows apart.

    Rows are dealt out by range and numbered within their partition; the sizes
    of the partitions before, a row each, are added.
    """
    spark = df.sparkSession
    dealt = materialize(df.repartitionByRange(n_shuffle(spark), *order).withColumn("part_", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    shift = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("shift_"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return dealt.withColumn(name, inside).join(F.broadcast(shift), "part_").withColumn(name, (F.col(name) + F.col("shift_")).cast("long")).drop("part_", "shift_")


def dense_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the dense rank of ``column``, from 1: the place of a value among the distinct values."""
    ranks = numbered(df.select(column).distinct(), [column], name).withColumn(name, F.col(name) + 1)
    return df.join(ranks, column)
