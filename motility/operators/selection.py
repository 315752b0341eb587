"""Cell selection: assembled features, valid rows and an ensemble's score.

Long tables have a row per ``row_id`` and ``feature``, with its ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_features(track: DataFrame, cell: DataFrame, track_columns: Sequence[str], cell_columns: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Track features and then cell features of a node as ``features array<double>``."""
    both = track.select(*on, *(F.col(c).alias(f"_t{i}") for i, c in enumerate(track_columns))).join(cell.select(*on, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(cell_columns))), list(on))
    ordered = [F.col(f"_t{i}").cast("double") for i in range(len(track_columns))] + [F.col(f"_c{i}").cast("double") for i in range(len(cell_columns))]
    return both.select(*on, F.array(*ordered).alias("features"))


def valid_rows(df: DataFrame, keys: Sequence[str], features: str = "features", volume: str = "vol", lo: float = 110, hi: float = 3060, min_len: int = 21) -> DataFrame:
    """Rows of tracks of more than ``min_len`` frames, with finite features only, and a volume strictly between ``lo`` and ``hi``."""
    finite = F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    long = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "track_id"))).where(F.col("_n") > min_len).drop("_n")
    return long.where((F.col(volume) > lo) & (F.col(volume) < hi) & finite)


def ensemble_score(long: DataFrame, members: DataFrame, thr: float = 0.6815) -> DataFrame:
    """``(row_id, score, selected)``: each member standardises with its own ``mu, sd`` and scores by a logistic of its ``coef`` and ``intercept``; the mean counts.

    ``members`` has a row per member and feature.
    """
    z = F.when(F.col("sd") != 0, (F.col("value") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    sums = long.join(members, "feature").groupBy("row_id", "member").agg(F.sum(z * F.col("coef")).alias("s"), F.max("intercept").alias("b"))
    each = sums.withColumn("p", 1 / (1 + F.exp(-(F.col("s") + F.col("b")))))
    return each.groupBy("row_id").agg(F.avg("p").alias("score")).withColumn("selected", F.col("score") > thr)


def scatter_labels(everything: DataFrame, selected: DataFrame, on: Sequence[str] = ("row_id",)) -> DataFrame:
    """Every row with ``selected``: rows that were filtered out are false."""
    return everything.join(selected.select(*on, "selected"), list(on), "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
