"""Intermediate tables and the spread of groups over tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which the driver and all executors must see. Only a master on this machine alone may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so later passes neither compute it again nor need its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """One side of a join whose sides both grow: they are sorted and merged. Spark takes the size of rows that were exploded or decoded from that of their file, and would send millions of them to the driver as a small table."""
    return df.hint("merge")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deals groups that are costly for their bytes to as many tasks as shuffles have; coalescing by bytes would put them into few."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def dealt_alike(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` whose rows are small in a shuffle and large when sorted, such as voxels: dealt to as many tasks as shuffles have, and merged.

    Left to itself, Spark would join tasks up to its advisory size in bytes, where ten million voxels meet in one.
    """
    return spread(left, keys), merged(spread(right, keys))


def in_ranges(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the number of the row's range in the given order, of as many as shuffles have tasks. Bounds come from the rows and hold about equal numbers of them; equal rows share a range.

    The table is stored, since bounds are sampled anew whenever the plan runs.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return stored(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), "ranges")


def forgotten(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` returned and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
