"""Behaviours: clusters of standardised cells, their shares by group, and the choice of their number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motility.sources.tables import stored


def union_selected(tables: Sequence[DataFrame], label: str = "selected") -> DataFrame:
    """The selected rows of all tables, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).where(F.col(label))


def global_track_ids(df: DataFrame, keys: Sequence[str] = ("grp", "volume", "capture")) -> DataFrame:
    """Adds ``global_track``: 1, 2 ... over all captures, by capture and track.

    Tracks are numbered within their capture; only a row per capture meets in one place.
    """
    tracks = df.select(*keys, "track_id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("track_id")))
    sizes = tracks.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return df.join(tracks.join(before, list(keys)), [*keys, "track_id"]).withColumn("global_track", (F.col("_b") + F.col("_r")).cast("long")).drop("_b", "_r")


def standardize(long: DataFrame, fit_where: Column) -> DataFrame:
    """z-scores of a long table; mean and sample deviation come from the rows of ``fit_where``. Constant features become 0."""
    stats = long.where(fit_where).groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return long.join(stats, "feature").withColumn("value", z).drop("_m", "_s")


def to_vectors(long: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A long table as ``features array<double>`` by row, in the order of the features."""
    return long.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"]).alias("features"))


def to_long(df: DataFrame, ids: Sequence[str], features: str = "features") -> DataFrame:
    """The inverse of ``to_vectors``; features count from 0."""
    return df.select(*ids, F.posexplode(features).alias("feature", "value")).withColumn("feature", F.col("feature").cast("long"))


#: Rows among which first centroids are drawn.
SEEDING_ROWS = 4000


def _first_centroids(sample: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Rows of the sample, each drawn by its squared distance to those before."""
    chosen = [sample[draw.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = far.sum()
        chosen.append(sample[draw.choice(len(sample), p=far / total) if total > 0 else draw.integers(len(sample))])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def kmeans_runs(df: DataFrame, runs: Sequence[tuple[int, int]], features: str = "features", max_iter: int = 50) -> list[tuple[np.ndarray, float]]:
    """Lloyd's algorithm for many ``(k, seed)`` at once: the centroids and the cost of each run.

    A pass over the rows measures the distances to the centroids of all runs that still move, in blocks of rows, and adds up sums, counts and costs in the task; so the passes are as many as the slowest run takes, however many runs there
    are. First centroids are drawn from ``SEEDING_ROWS`` rows by a hash. A cluster that loses all rows keeps its centroid. No rows: no centroids.
    """
    data = stored(df.select(F.col(features).cast("array<double>").alias("x")), "vectors")
    first = np.array([r["x"] for r in data.orderBy(F.xxhash64("x"), "x").limit(SEEDING_ROWS).collect()])
    if not len(first):
        return [(np.empty((0, 0)), 0.0) for _ in runs]
    centroids = [_first_centroids(first, k, np.random.default_rng([seed, k])) for k, seed in runs]
    costs, moving, width = np.full(len(runs), np.inf), list(range(len(runs))), first.shape[1]
    for _ in range(max_iter + 1):
        now = [centroids[i] for i in moving]
        flat, bounds = np.concatenate(now), np.cumsum([0, *map(len, now)])

        def sums(batches: Iterator[pa.RecordBatch], flat=flat, bounds=bounds) -> Iterator[pa.RecordBatch]:
            total, norm = np.zeros((len(flat), width + 2)), (flat * flat).sum(axis=1)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for a in range(0, len(x), 512):
                    block = np.column_stack([x[a : a + 512], np.ones(len(x[a : a + 512]))])
                    far = norm - 2 * block[:, :width] @ flat.T
                    own = (block[:, :width] ** 2).sum(axis=1)
                    for p, q in zip(bounds[:-1], bounds[1:], strict=True):
                        near = far[:, p:q].argmin(axis=1)
                        hot = np.zeros((len(block), q - p))
                        hot[np.arange(len(block)), near] = 1
                        total[p:q, : width + 1] += hot.T @ block
                        total[p:q, width + 1] += hot.T @ np.maximum(0, far[np.arange(len(block)), p + near] + own)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, np.arange(len(flat)), "right") - 1), pa.array(np.arange(len(flat))), pa.array(list(total), pa.list_(pa.float64()))], names=["run", "centroid", "sums"])

        def added(table: pa.Table) -> pa.Table:
            ids, at = np.unique(table.column("centroid").to_numpy(), return_inverse=True)
            total = np.zeros((len(ids), width + 2))
            np.add.at(total, at, table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(table), -1))
            return pa.Table.from_arrays([pa.array(ids), pa.array(list(total), pa.list_(pa.float64()))], names=["centroid", "sums"])

        parts = data.mapInArrow(sums, "run long, centroid long, sums array<double>").groupBy("run").applyInArrow(added, "centroid long, sums array<double>")  # a row per task and centroid comes in
        total = np.array([r["sums"] for r in parts.orderBy("centroid").collect()])
        still = []
        for k, i in enumerate(moving):
            mine = total[bounds[k] : bounds[k + 1]]
            full = mine[:, width] > 0
            new = np.where(full[:, None], mine[:, :width] / np.maximum(1, mine[:, width, None]), centroids[i])
            costs[i] = mine[:, width + 1].sum()
            if np.abs(new - centroids[i]).max() > 1e-6:
                centroids[i] = new
                still.append(i)
        moving = still
        if not moving:
            break
    return list(zip(centroids, costs.tolist(), strict=True))


def assigned(df: DataFrame, centroids: np.ndarray, features: str = "features", name: str = "cluster") -> DataFrame:
    """Adds the number (from 1) of the nearest centroid."""

    @F.arrow_udf("long")
    def nearest(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
        far = (centroids * centroids).sum(axis=1) - 2 * rows @ centroids.T if len(rows) else np.zeros((0, 1))
        return pa.array(far.argmin(axis=1) + 1, pa.int64())

    return df.withColumn(name, nearest(F.col(features)))


def kmeans(df: DataFrame, k: int, seed: int = 1, replicates: int = 10, features: str = "features", max_iter: int = 50) -> tuple[DataFrame, DataFrame, float]:
    """The best of ``replicates`` K-means fits: ``(rows with cluster, centroids, cost)``. Clusters count from 1."""
    best, cost = min(kmeans_runs(df, [(k, seed + i) for i in range(replicates)], features, max_iter), key=lambda run: run[1])
    centroids = df.sparkSession.createDataFrame([(i + 1, [float(x) for x in c]) for i, c in enumerate(best)], "cluster long, centroid array<double>")
    return assigned(df, best, features), centroids, float(cost)


def behavior_histogram(df: DataFrame, by: str = "grp", cluster: str = "cluster") -> DataFrame:
    """``(by, cluster, n, share)``: the share of each cluster in each group, zeros kept."""
    counts = df.groupBy(by, cluster).agg(F.count("*").alias("n"))
    grid = counts.select(by).distinct().crossJoin(counts.select(cluster).distinct())  # groups times clusters, both few
    full = grid.join(counts, [by, cluster], "left").fillna(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def wide_histogram(histogram: DataFrame, clusters: Sequence[int], by: str = "grp") -> DataFrame:
    """A row per group and a column of shares per cluster."""
    return histogram.groupBy(by).pivot("cluster", list(clusters)).agg(F.first("share"))


def histogram_intersection(histogram: DataFrame, by: str = "grp", cluster: str = "cluster") -> DataFrame:
    """``(a, b, overlap)``: the sum of the lesser shares for each pair of groups a < b. Its greatest value is the worst case."""
    side = lambda n: histogram.select(F.col(by).alias(n), cluster, F.col("share").alias(f"s{n}"))
    return side("a").join(side("b"), cluster).where("a < b").groupBy("a", "b").agg(F.sum(F.least("sa", "sb")).alias("overlap"))


def select_k(criterion: DataFrame) -> DataFrame:
    """The least interior strict local minimum of ``(k, value)``, the first of equal ones; 1 without any. One row ``k``."""
    order = Window.orderBy("k")  # a row per candidate
    inner = criterion.withColumn("a", F.lag("value").over(order)).withColumn("b", F.lead("value").over(order)).where("value < a and value < b")
    return inner.agg(F.coalesce(F.min_by("k", F.struct("value", "k")), F.lit(1).cast("long")).alias("k"))


def worst_overlaps(clusterings: DataFrame, by: str = "grp") -> DataFrame:
    """``(k, value)``: the greatest histogram intersection of any two groups, for each clustering ``(k, by, cluster)`` of the same rows."""
    counts = clusterings.groupBy("k", by, "cluster").agg(F.count("*").alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("k", by)))
    side = lambda n: share.select("k", "cluster", F.col(by).alias(n), F.col("share").alias(f"s{n}"))
    groups = counts.select("k", by).distinct()
    pairs = groups.select("k", F.col(by).alias("a")).join(groups.select("k", F.col(by).alias("b")), "k").where("a < b")
    shared = side("a").join(side("b"), ["k", "cluster"]).where("a < b").groupBy("k", "a", "b").agg(F.sum(F.least("sa", "sb")).alias("overlap"))
    return pairs.join(shared, ["k", "a", "b"], "left").groupBy("k").agg(F.max(F.coalesce("overlap", F.lit(0.0))).alias("value"))


def choose_behaviors(rows: DataFrame, ks: Sequence[int] = range(2, 11), restarts: int = 10, seed: int = 1, by: str = "grp", features: str = "features") -> tuple[DataFrame, DataFrame, int]:
    """The sweep over the number of clusters: ``(rows with cluster, centroids, k)``.

    For each k a fit (with one seed) gives the histograms of the groups; the k at the first least local minimum of the greatest intersection of two groups is fitted anew with ``restarts`` seeds. The fits of
    all k share their passes over the rows, and so do all restarts.
    """
    fits = zip(ks, kmeans_runs(rows, [(k, seed) for k in ks], features), strict=True)
    tried = [assigned(rows, centroids, features).select(F.lit(k).cast("long").alias("k"), by, "cluster") for k, (centroids, _) in fits]
    chosen = int(select_k(worst_overlaps(stored(reduce(DataFrame.unionByName, tried), "sweep"), by)).first()["k"])
    fitted, centroids, _ = kmeans(rows, max(2, chosen), seed, restarts, features)
    return fitted, centroids, chosen


def assign_nearest_centroid(long: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(row_id, cluster)``: the nearest of ``centroids(cluster, feature, centre)``; of equal ones the least."""
    gap = F.col("value") - F.col("centre")
    far = long.join(centroids, "feature").groupBy("row_id", "cluster").agg(F.sum(gap * gap).alias("d"))
    return far.groupBy("row_id").agg(F.min_by("cluster", F.struct(F.round("d", 9), "cluster")).alias("cluster"))


def long_centroids(long: DataFrame) -> DataFrame:
    return long.groupBy("cluster", "feature").agg(F.avg("value").alias("centre"))


def davies_bouldin(long: DataFrame) -> DataFrame:
    """The Davies-Bouldin index of a long table with ``cluster``: one row ``davies_bouldin``."""
    centres = long_centroids(long)
    gap = F.col("value") - F.col("centre")
    rows = long.join(centres, ["cluster", "feature"]).groupBy("cluster", "row_id").agg(F.sqrt(F.sum(gap * gap)).alias("d"))
    spread = rows.groupBy("cluster").agg(F.avg("d").alias("s"))
    side = lambda n: centres.select(F.col("cluster").alias(n), "feature", F.col("centre").alias(f"c{n}"))
    apart = side("a").join(side("b"), "feature").where("a != b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ca") - F.col("cb")) * (F.col("ca") - F.col("cb")))).alias("m"))
    both = apart.join(spread.toDF("a", "sa"), "a").join(spread.toDF("b", "sb"), "b")
    worst = both.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.col("m")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def sweep_top(df: DataFrame, grid: Iterable[dict], n: int = 5, row_id: str = "row_id", features: str = "features") -> DataFrame:
    """The ``n`` settings of a grid (``k``, ``seed``, ``columns``) with the least Davies-Bouldin index."""
    together: dict[tuple, list[dict]] = {}
    for setting in grid:
        together.setdefault(tuple(setting.get("columns") or ()), []).append(setting)
    df, scored = stored(df.select(row_id, features), "rows"), []
    for columns, settings in together.items():  # settings with the same columns share their passes over the rows
        chosen = df.withColumn(features, F.array(*(F.col(features)[c] for c in columns))) if columns else df
        for setting, (centroids, _) in zip(settings, kmeans_runs(chosen, [(s["k"], s.get("seed", 1)) for s in settings], features), strict=True):
            index = davies_bouldin(to_long(stored(assigned(chosen, centroids, features), "assigned"), [row_id, "cluster"], features))
            scored.append(index.select(F.lit(setting["k"]).alias("k"), F.lit(setting.get("seed", 1)).alias("seed"), F.lit(str(columns or "all")).alias("columns"), "davies_bouldin"))
    return reduce(DataFrame.unionByName, scored).orderBy("davies_bouldin", "k", "seed", "columns").limit(n)
