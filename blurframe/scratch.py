"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Let executors import this package when it was not installed on them.

    Python workers take ``PYTHONPATH`` from the context's environment; on a
    cluster the package itself comes with ``--py-files`` or an image.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where it may be unset, a folder below the warehouse.

    On a cluster a folder that is not shared would lose data, so there the
    setting is required.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Drops an execution's shuffle files when it ends; what it wrote stands in for them.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    Cuts the lineage with files that outlive any executor, and fixes values
    that depend on how rows were dealt out (row ids, partition numbers). The
    shuffle files behind the write are dropped at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`materialize` returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {str(Path(f).parent) for f in df.inputFiles()}:
        name = name.replace("file:/", "file:///", 1) if name.startswith("file:/") else name
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count proves ``df`` small; else leave the join to be shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
