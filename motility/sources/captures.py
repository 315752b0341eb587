"""Sources and sinks: file manifests, calibration, per-capture tables and the final cell table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("grp", "volume", "capture")
#: Ends of folder names that hold results rather than captures.
RESULT_FOLDERS = ("labels", "_pred", "volumes_init")


def list_files(spark: SparkSession, root: str, glob: str = "*", exclude: Sequence[str] = RESULT_FOLDERS) -> DataFrame:
    """``(path, length, folder)`` of the files below ``root`` whose name fits ``glob``, but for those in folders that end as ``exclude`` says.

    Contents are not read: only path and length are asked of the source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    files = files.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    for end in exclude:
        files = files.where(~F.col("folder").rlike(re.escape(end) + r"(/|$)"))
    return files


def capture_folders(files: DataFrame) -> DataFrame:
    """Each folder of a manifest once."""
    return files.select("folder").distinct()


def series_extent(df: DataFrame, keys: Sequence[str] = KEYS, axes: Sequence[str] = ("t", "z", "c")) -> DataFrame:
    """The greatest frame, plane and channel number of each sequence, as ``n_<axis>``."""
    return df.groupBy(*keys).agg(*(F.max(a).alias(f"n_{a}") for a in axes))


def apply_calibration(df: DataFrame, calibration: DataFrame, keys: Sequence[str] = KEYS, v_size_x: float = 0.5) -> DataFrame:
    """Adds ``z_factor`` (plane distance over pixel size) and ``t_factor`` (frame interval); null for captures without calibration.

    A calibration row per capture is a small side, which Spark broadcasts by its measured size.
    """
    factors = calibration.select(*keys, (F.col("dz") / F.lit(v_size_x)).alias("z_factor"), F.col("dt").alias("t_factor"))
    return df.join(factors, list(keys), "left")


def sanitize_names(names: Sequence[str]) -> list[str]:
    """Spaces, brackets and slashes become underscores."""
    return [re.sub(r"[ ()/]", "_", n) for n in names]


def write_cells(df: DataFrame, path: str) -> None:
    """The final table, as ``path/table`` (Parquet, clean names) and ``path/csv`` (no header)."""
    named = df.toDF(*sanitize_names(df.columns))
    named.write.parquet(f"{path}/table")
    named.write.csv(f"{path}/csv", header=False)


def read_cells(spark: SparkSession, path: str, n_features: int, ids: Sequence[str] = ("grp", "cluster", "volume", "capture", "track_id", "t")) -> DataFrame:
    """The headerless table as ``features array<double>`` and whole-number id columns."""
    schema = ", ".join([*(f"f{i} double" for i in range(n_features)), *(f"{c} double" for c in ids)])
    df = spark.read.schema(schema).csv(f"{path}/csv", header=False)
    return df.select(F.array(*(f"f{i}" for i in range(n_features))).alias("features"), *(F.col(c).cast("long").alias(c) for c in ids))


def write_by_capture(df: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """One folder per capture; rows are dealt by capture and a salt-free hash first, so a folder has few files."""
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)
